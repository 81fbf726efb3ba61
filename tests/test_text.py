import unicodedata

import pytest
from pyspark.sql import functions as F

from gristmill.functions import metadata as M
from gristmill.functions import parse as P
from gristmill.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text", ["", "  ", "one", " two  words ", "a\u00a0b\nc\td", None])
def test_word_count_is_split(spark, text):
    assert one(spark, text, T.word_count) == len((text or "").split())


def test_token_estimate(spark):
    assert one(spark, "a b c d", T.token_estimate) == int(4 * 1.3)
    assert one(spark, "é" * 10, T.summary_estimate) == 20


def test_grounding_tokens(spark):
    assert one(spark, "PCIe x16-slot, grün!", T.grounding_tokens) == ["pcie", "x", "16", "slot", "grün"]


def test_windows_and_grams(spark):
    assert one(spark, "a b c", lambda c: T.windows(T.tokens(c), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.windows(T.tokens(c), 2)) == []
    assert one(spark, "abcd", lambda c: T.char_ngrams(c, 2, 3)) == ["ab", "bc", "cd", "abc", "bcd"]
    assert one(spark, "a", lambda c: T.char_ngrams(c, 2, 3)) == []


def test_sentences(spark):
    text = "Dr. A saw 6. It went.\nNext line here.\n- first\n- second\n\nlast bit\nwrapped on"
    got = one(spark, text, T.sentences)
    from gristmill.operators.chunking import sentences

    assert got == sentences(text)
    assert "last bit\nwrapped on" in got


def test_compliance_normalise(spark):
    for text in ["P4ssw0rd  2024", "Straße", "ＡＢＣ", "раssword", None]:
        got = one(spark, text, T.compliance_normalise)
        if text is None:
            assert got is None
        else:
            table = str.maketrans(T.CONFUSABLES | T.LEET)
            assert got == " ".join(unicodedata.normalize("NFKC", text.lower()).casefold().translate(table).split())


def test_mask_order_and_escapes(spark):
    t = "card 1234-5678-9012-3456 mail a.b@c.de ssn 123-45-6789 ip 10.0.0.1 password: x1"
    got = one(spark, t, T.mask)
    assert got == "card mask_credit_card mail mask_email ssn [SSN] ip mask_ip_last_octet mask_kv_secret"
    assert one(spark, "pw = abc; Pwd=xyz, rest", T.mask) == "[PASSWORD]; mask_kv_secret, rest"
    specs = [("b", 2, "second", "$1\\"), ("a", 1, "first", "second")]
    assert one(spark, "first", lambda c: T.mask(c, specs)) == "$1\\"


def test_mask_credentials(spark):
    got = one(spark, "see https://u:p@h.de/x?token=abc&a=1 Authorization: Bearer xyz secret=foo", T.mask_credentials)
    assert "u:p" not in got and "abc" not in got and "xyz" not in got and "foo" not in got and "a=1" in got


@pytest.mark.parametrize("label,want", [("EN", "en"), (" en_GB ", "en"), ("Deutsch", "de"), ("por", "pt"), ("es-MX", "es"), ("n/a", None), ("und", None), ("", None), (None, None), ("xx", None)])
def test_canonical_language(spark, label, want):
    assert one(spark, label, M.canonical_language) == want


@pytest.mark.parametrize(
    "path,want",
    [("/srv/corpus/Fauna/2020/x.md", "fauna"), ("D:\\corpus\\Hardware\\2017\\a.png", "hardware"), ("https://h.example/fauna/x.html", "fauna"), ("/srv/corpus//RETRIEVAL/./2021/x", "retrieval"), ("x", None), (None, None)],
)
def test_path_domain(spark, path, want):
    assert one(spark, path, M.path_domain) == want


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], [3.0, 4.0], [0.0, 0.0])], "a array<string>, b array<string>, v array<float>, z array<float>")
    r = df.select(T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("a"), F.col("b")), T.cosine(F.col("v"), F.col("v")), T.cosine(F.col("v"), F.col("z")), T.l2_normalise(F.col("v"))).first()
    assert r[0] == pytest.approx(1 / 3) and r[1] == 0.5 and r[2] == pytest.approx(1.0) and r[3] == 0.0 and r[4] == pytest.approx([0.6, 0.8])
    assert one(spark, None, lambda c: T.levenshtein_similarity(c, F.lit(None))) == 1.0


def test_language_fallbacks(spark):
    df = spark.createDataFrame([(2, "de", 0.99, "en", 0.1), (20, "de", 0.7, "en", 0.1), (20, "xx", 0.5, "fr", 0.3), (20, "xx", 0.5, "fr", 0.1)], "n int, a string, s double, b string, t double")
    got = [r[0] for r in df.select(T.detected_language(F.col("n"), F.col("a"), F.col("s"), F.col("b"), F.col("t"), ["en", "de", "fr"])).collect()]
    assert got == ["en", "de", "fr", "en"]


@pytest.mark.parametrize(
    "text,want",
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": [1, 2', '{"a": [1, 2]}'), ('{"a": {"x", "y"}}', '{"a": ["x", "y"]}'), ('{"a": 1,}', '{"a": 1}'), ("none", None), (None, None)],
)
def test_repair_json(text, want):
    assert P.repair_json(text) == want


def test_diagram_claims():
    assert P.diagram_claims("graph TD\nA[Cat] -->|eats| B(Fish)\nC --> B\nD\nA --- D") == ["Cat eats Fish", "C leads to Fish", "Cat connected to D"]
    assert P.diagram_claims(None) == [] and P.diagram_claims("graph TD\nX[Alone]") == ["Alone"]


def test_answer_claims():
    got = P.answer_claims("# Head\nFirst. Second one.\n- item a\n1. item b\n```\ncode.\n```\n")
    assert got == [("prose", "First."), ("prose", "Second one."), ("list", "item a"), ("list", "item b")]


@pytest.mark.parametrize("text,want", [("a\nb\n- 4 -", "4"), ("Page iv\ntext here", "iv"), ("x\nPage 3 of 9", "3"), ("no label here\nat all", ""), ("", ""), (None, ""),
    ("Report | Page 5", "5"), ("User Guide 5", "5"), ("ii P620 User Guide", "ii"), ("Intro\nPage 5 of 118", "5"), ("P620\nUser Guide", ""), ("7. Headset connector\nsome body text", ""), ("body text\n12\n\n", "12"),
    ("Contents\n© All rights 2020, 2021 i", "i"), ("2 P620 User Guide\nbody", "2"), ("Rear\nChapter 1 . Meet it 3", "3"), ("one\nof the mix", ""), ("a\n* XIV *", "xiv")])
def test_printed_label(spark, text, want):
    assert one(spark, text, P.page_label) == want


def test_html_text():
    assert P.html_text("<html><nav>menu</nav><p>Hello <b>you</b></p><script>x()</script></html>") == "Hello you"
    assert P.html_text(None) == ""


def test_roman_and_stem():
    assert [P.roman_value(x) for x in ("iv", "xii", "MCMXC")] == [4, 12, 1990]
    assert P.stem("running") == "run" and P.stem("glass") == "glass" and P.stem("studies") == "study"


def test_neighbours_of_all_labels(spark, data):
    import math

    import __spark_entry__ as entry

    last, want = {}, {}
    for r in sorted(spark.read.parquet(f"{data}/embeddings.parquet").collect(), key=lambda r: r["vec_id"]):
        v = list(r["embedding"])
        if (u := last.get(r["label"])) is not None:
            want[r["vec_id"]] = sum(x * y for x, y in zip(u, v)) / math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
        last[r["label"]] = v
    got = {r["vec_id"]: r["cosine"] for r in entry.queries()["win_consecutive_cosine"](spark, data).collect()}
    assert len(last) > 1 and set(got) == set(want) and all(abs(got[k] - x) < 1e-5 for k, x in want.items())

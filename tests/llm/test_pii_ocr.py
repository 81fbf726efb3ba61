import json
import random

import numpy as np

from gristmill.llm import ocr, ocr_train, pii, pii_table, queries


def test_viterbi_against_brute_force():
    r = np.random.default_rng(1)
    t = pii.Tagger(["f"], np.zeros((1, 2 * pii.REACH + 1, len(pii.LABELS))), r.normal(size=(len(pii.LABELS),) * 2))
    for n in (1, 2, 4):
        scores = r.normal(size=(4, 1, len(pii.LABELS))).astype(np.float32)
        got = t._viterbi(scores, np.array([n]))[:n, 0]

        def total(path):
            s = t.moves[0, path[0]] + scores[0, 0, path[0]]
            return s + sum(t.moves[a, b] + scores[i + 1, 0, b] for i, (a, b) in enumerate(zip(path, path[1:])))

        import itertools

        best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=total)
        assert abs(total(tuple(got)) - total(best)) < 1e-3


def test_held_out_accuracy():
    rows = pii_table.labelled(400, 4242)
    hit = miss = extra = 0
    for (_, spans), found in zip(rows, pii.find([t for t, _ in rows])):
        want, got = {(k, a, b) for a, b, k in spans}, set(found)
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    assert hit / (hit + miss) > 0.97 and hit / (hit + extra) > 0.97


def test_batches_do_not_change_labels():
    texts = [t for t, _ in pii_table.labelled(60, 5)]
    assert pii.find(texts) == [pii.find([t])[0] for t in texts]


def test_masking_leaves_the_rest(spark):
    t = "Please send the signed form to Emily Tanwick at daniel.falk@ulmbor.example. Call +1 241 555 0170 if the door is locked. Ticket INC-123456 lists 40 pages."
    rows = [(1, t, "x"), (2, None, "x"), (3, "", "x"), (4, "Batch 708 391 086 was stored next to invoice K.811900 in hall 52.", "x"), (1, t, "x")]
    blocks = spark.createDataFrame(rows, "block_id bigint, text string, kind string")
    got = {r["block_id"]: r["text"] for r in pii.masked(blocks).collect()}
    assert got[1] == "Please send the signed form to [NAME] at [EMAIL]. Call [PHONE] if the door is locked. Ticket INC-123456 lists 40 pages."
    assert got[2] is None and got[3] == "" and got[4] == rows[3][1]
    items = [tuple(r) for r in pii.personal_items(blocks).collect()]
    assert sorted(items) == sorted([(1, "name", 1), (1, "email", 1), (1, "phone", 1)] * 2)
    assert pii.personal_items(blocks.limit(0)).count() == 0 and pii.masked(blocks.limit(0)).count() == 0
    long = "nothing here " * 20000 + t
    assert len(pii.find([long])[0]) == 3


def test_found_items_are_numbered_by_kind(spark, tmp_path):
    t = "Please send the signed form to Emily Tanwick at daniel.falk@ulmbor.example. Call +1 241 555 0170 if the door is locked. Ticket INC-123456 lists 40 pages."
    spark.createDataFrame([(1, t), (2, f"{t}\n{t}"), (3, None)], "block_id bigint, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = sorted(tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect())
    assert got == sorted((b, k, n) for b, times in ((1, 1), (2, 2)) for k in ("name", "email", "phone") for n in range(1, times + 1))


def test_distance():
    assert ocr.distance("server", "scrver") == 0.3 and ocr.distance("aquarium", "aquariurn") == 0.3 and ocr.distance("supplier", "suppher") == 0.3
    assert ocr.distance("server", "server") == 0.0 and ocr.distance("server", "serxer") == 1.0 and ocr.distance("a", "bcdefgh") >= 1.3


def test_numbers_of_lines():
    for line, n in [("- 4 -", 4), ("[ii]", 2), ("Page 13 of 51", 13), ("Seite 5 von 9", 5), ("  7", 7), ("Pagina iii di 30", 3), ("Page l3", 13)]:
        assert ocr.number_of(line) == n, line
    for line in ["44 €.", "Annual Notes 4", "", "lines of 4 text here", "Handbook of X 18"]:
        assert ocr.number_of(line) is None, line


def test_models_on_held_out_noise():
    m = ocr.model()
    x, y = ocr_train.rank_rows(random.Random(901))
    s = m["rank"].score(x) >= 0
    assert y[s].mean() > 0.95 and s[y == 1].mean() > 0.95
    x, y = ocr_train.cut_rows(random.Random(902))
    assert ((x @ m["cut"].T).argmax(1) == y).mean() > 0.97


def test_the_lookup_misses_no_misreading(spark):
    missed = []
    m = ocr.model()
    x, y = ocr_train.rank_rows(random.Random(903), missed)
    s = m["rank"].score(x) >= 0
    assert missed == [] and y[s].mean() > 0.95 and (s & (y == 1)).sum() / (y.sum() + len(missed)) > 0.95
    # misreadings that change the length across that at which the grams do, or touch both halves of a word
    pairs = [("empty", "ernpty"), ("rampa", "rarnpa"), ("small", "srnall"), ("wüste", "wiiste"), ("camp", "carnp"), ("arm", "arrn"), ("clear", "dear"), ("relied", "rehed"), ("declare", "dedare"), ("modern", "modem")]
    rows = [(w, 5000, 800) for w, _ in pairs] + [(s, 0, 40) for _, s in pairs]
    counts = spark.createDataFrame(rows, "word string, clean long, paged long")
    got = {r["word"]: r["right"] for r in ocr.corrections(counts, counts.where("clean = 0")).collect()}
    assert got == {s: w for w, s in pairs}


def _page(head, body, foot):
    return f"{head}\n\n{body}\n\n{foot}"


def test_noise_and_repair(spark):
    words = "the night operator counted the water samples behind the old cabinet while the backup was still running and nobody asked".split()
    plain = " ".join(words) + ". follow-up and long-term remain."
    b1 = "The night operator counted the watcr sam-\nples behind the old cabinet while the back-\nup was still running and nobody fol-"
    b2 = "lowed the follow-\nup. The night operator counted samples zwischen Ein-\nund Ausgang behind the old cabinet.\n\nAnother paragraph 44."
    pages = [_page("Annual Notes on Velmar", b1, "- 4 -"), _page("Annual Notcs on Velmar", b2, "- 5 -"), _page("Annual Notes on Velmar", "The last page of it was here.", "- 6 -")]
    rows = [(1, 10 + i, i + 1, i + 1, t) for i, t in enumerate(pages)] + [(2, 100 + i, i, 0, plain + " backup followed samples followed water. Ein- und Ausgang.") for i in range(40)] + [(3, 200, 1, 1, None), (3, 201, 2, 2, "")]
    blocks = spark.createDataFrame(rows, "file_id bigint, block_id bigint, block_no int, page_number int, text string")
    got = {tuple(r) for r in ocr.found(blocks).collect()}
    assert {(10, "ocr_char", "water"), (10, "hyphen", "samples"), (10, "hyphen", "backup"), (10, "hyphen", "followed"), (11, "hyphen", "follow-up")} <= got
    assert {(10, "page_no", "- 4 -"), (11, "page_no", "- 5 -"), (12, "page_no", "- 6 -"), (10, "header", "Annual Notes on Velmar"), (11, "header", "Annual Notcs on Velmar"), (12, "header", "Annual Notes on Velmar")} <= got
    assert not any(k == "hyphen" and "ein" in w for _, k, w in got) and len(got) == 11
    text = {r["file_id"]: r["text"] for r in ocr.repaired(blocks).collect()}[1]
    assert text.startswith("The night operator counted the water samples behind the old cabinet while the backup was still running and nobody followed the follow-up. The night")
    assert "Velmar" not in text and "- 5 -" not in text and "zwischen Ein- und Ausgang" in text and text.endswith("Another paragraph 44.\n\nThe last page of it was here.")
    assert ocr.found(blocks.limit(0)).count() == 0


def test_weights_come_from_the_tables():
    assert len(json.load(open(ocr.MODEL))["furniture"]) == 11
    assert pii.tagger().weights.shape[1] == (2 * pii.REACH + 1) * len(pii.LABELS)


def test_long_files_are_gone_through_in_stretches(spark):
    n = ocr.STRETCH + 40
    rows = [(1, i, i, i, _page("Annual Notes on Velmar", "samples of the water behind the old cabinet while the back-", f"- {i} -")) for i in range(1, n + 1)]
    rows += [(2, 10_000 + i, i, 0, "samples of the water behind the old cabinet while the backup was running") for i in range(3)]
    blocks = spark.createDataFrame([(f, b, k, p, t.replace("\n\nsamples", "\n\nup samples") if p else t) for f, b, k, p, t in rows], "file_id bigint, block_id bigint, block_no int, page_number int, text string")
    got = [tuple(r) for r in ocr.found(blocks).collect()]
    kinds = {k: sum(x[1] == k for x in got) for k in ("header", "page_no", "hyphen", "ocr_char")}
    assert kinds == {"header": n, "page_no": n, "hyphen": n - 1, "ocr_char": 0}
    assert {x[2] for x in got if x[1] == "hyphen"} == {"backup"}


def test_long_lines_are_no_running_lines(spark):
    long = "The night operator counted the water samples behind the old cabinet. " * 12
    blocks = spark.createDataFrame([(1, i, i, i, long + "x" * i) for i in range(1, 5)], "file_id bigint, block_id bigint, block_no int, page_number int, text string")
    assert ocr.found(blocks).where("kind in ('header', 'page_no')").count() == 0


def test_any_number_of_misreadings_keeps_the_grams(spark):
    for a, bs in ocr.MISREAD.items():
        assert all(ocr.alike(a.lower()) == ocr.alike(b) for b in bs if a != "B"), a
    pairs = [("moment", "rnornent"), ("common", "cornrnon"), ("memory", "rnernory"), ("ledger", "1edqer"), ("international", "intcmotionol"), ("documentation", "docurnentatlon")]
    rows = [(w, 5000, 800) for w, _ in pairs] + [(s, 0, 40) for _, s in pairs] + [(f"word{i}other", 50, 5) for i in range(50)]
    counts = spark.createDataFrame(rows, "word string, clean long, paged long")
    got = {r["word"]: r["right"] for r in ocr.corrections(counts, counts.where("clean = 0")).collect()}
    assert all(got.get(s) == w for w, s in pairs if ocr.distance(w, s) < 1) and len(got) >= 5


def test_recall_of_the_lookup_alone():
    """Right words among the candidates of twice and three times misread ones, and of words with one other change beside a misreading."""
    r = random.Random(31)
    v = ocr_train.vocabulary(r)
    often = [0] * ocr.BUCKETS
    for w in v:
        for g in ocr._grams(w, ocr._q(len(ocr.alike(w)))):
            often[ocr._bucket(g)] += 1
    keys = ocr.Grams(often)
    by = {}
    for w in v:
        for k in keys.right(w):
            by.setdefault(k, set()).add(w)
    hit = all_ = 0
    for w in v:
        for n in (1, 2, 3):
            s = ocr_train.misread(w, r, n)
            if n == 3 and s and len(w) > 4:  # one letter lost
                i = r.randrange(len(s))
                s = s[:i] + s[i + 1 :]
            if s and s != w:
                all_ += 1
                hit += any(w in by.get(k, ()) for k in keys.seen(s))
    assert all_ > 3000 and hit / all_ > 0.995


def test_words_cut_between_parts_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(ocr, "PART", 2)
    texts = ["The night operator counted water samples here and the back-", "up was running. Nobody asked for the other sam-", "ples behind the cabinet. It ended"]
    rows = [(1, i, i + 1, i + 1, t) for i, t in enumerate(texts)] + [(2, 100 + i, i, 0, "backup samples of water behind the cabinet. the backup was running. samples ended") for i in range(30)]
    blocks = spark.createDataFrame(rows, "file_id bigint, block_id bigint, block_no int, page_number int, text string")
    got = {r["part"]: (r["text"], r["goes_on"]) for r in ocr.repaired(blocks).collect()}
    assert got[0] == ("The night operator counted water samples here and the backup", True)
    assert got[1] == ("was running. Nobody asked for the other samples behind the cabinet. It ended", True)


def test_stretches_of_long_texts_change_nothing(monkeypatch):
    texts = [" ".join(t for t, _ in pii_table.labelled(30, k)) for k in range(3)]
    want = pii.find(texts)
    for longest, shared in ((300, 80), (120, 60)):
        monkeypatch.setattr(pii, "LONGEST", longest)
        monkeypatch.setattr(pii, "SHARED", shared)
        assert pii.find(texts) == want

import random

from gristmill.llm import encoding, language, leaks

ITEM = "The Velpalith caravan left Havriqet with 2435 camels and reached Savzekor after 475 days without the Grimovane guide. How many Zélmorix units did Noxtaqet report in 472?"


def _disguise(text, r):
    out = []
    for w in text.split():
        w = r.choice([w, w.upper(), f"**{w}**", f"_{w}_", w.replace("a", "a​"), f"<b>{w}</b>", w.replace("e", "é")])
        out.append(w)
    return r.choice([" ", "\n", "  "]).join(out)


def test_disguised_copies_are_found_with_offsets():
    r = random.Random(1)
    ix = leaks.ItemIndex([(7, ITEM), (8, "another item of which nothing stands anywhere in any of these documents at all")])
    for _ in range(40):
        body = _disguise(ITEM, r)
        text = "Before it. " + body + " After it."
        found = ix.find(text)
        assert [f[0] for f in found] == [7] and found[0][1] == found[0][2]
        a, b = found[0][3][0][0], found[0][3][-1][1]
        assert leaks.stream(text[a:b]) == leaks.stream(ITEM)


def test_against_brute_force():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(3, 40)))) for i in range(12)]
    ix = leaks.ItemIndex(items)
    for _ in range(60):
        words = [r.choice(vocab) for _ in range(60)]
        i, t = r.choice(items)
        w = t.split()
        a = r.randrange(len(w))
        words[20:20] = w[a : a + r.randint(1, 30)]
        stream = "".join(words)
        want = set()
        for j, u in items:
            v = u.split()
            n = min(8, len(v))
            cover = {k + x for k in range(len(v) - n + 1) if "".join(v[k : k + n]) in stream for x in range(n)}
            if len(cover) >= 0.5 * len(v):
                want.add(j)
        assert {f[0] for f in ix.find(" ".join(words))} == want


def test_leaks_edges(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM, "a"), (2, None, "a"), (3, "", "a"), (4, ITEM[:40], "a"), (1, "x " + ITEM, "a")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "!!"), (None, "some text here")], "item_id bigint, text string")
    got = leaks.leaked_items(docs, items)
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(1, 1), (1, 1)]
    small = leaks.leaked_items(docs, items, block_bytes=20)
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == {(1, 1)}
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


EN = "The night operator counted the water samples behind the old cabinet. Nobody had asked for it, although the weather was warm."
DE = "Der Nachtwächter zählte die Wasserproben hinter dem alten Schrank. Niemand hatte danach gefragt, obwohl es warm war."
FR = "Le gardien de nuit a compté les échantillons derrière la vieille armoire. Personne ne l’avait demandé, malgré la chaleur."


def test_passages_and_labels(spark):
    samples = spark.createDataFrame([("en", 1, EN), ("de", 1, DE), ("fr", 1, FR), ("xx", 1, "zz"), ("en", 2, None)], "lang string, sample_no int, text string")
    files = spark.createDataFrame([(1, "en", "k"), (2, "German", "k"), (3, None, "k"), (4, "fr-CA", "k"), (5, "en", "k")], "file_id bigint, meta_language string, lang string")
    blocks = spark.createDataFrame(
        [(1, 1, EN), (1, 2, EN + " " + DE), (2, 1, EN), (2, 2, EN), (3, 1, DE), (4, 1, FR), (4, 2, None), (4, 3, ""), (4, 4, "data\n├── abc/\n└── der.txt"), (5, 1, "12 34"), (None, 1, DE)],
        "file_id bigint, block_no int, text string",
    )
    got = {tuple(r) for r in language.wrong_or_departing(files, blocks, samples).collect()}
    assert got == {(1, 2, "de"), (2, 0, "en"), (3, 0, "de")}
    per_file = {r["file_id"]: r for r in language.languages(files, blocks, samples)[0].collect()}
    assert 5 not in per_file and 0 < per_file[3]["confidence"] <= 1
    assert language.wrong_or_departing(files, blocks.limit(0), samples).count() == 0
    assert language.wrong_or_departing(files.limit(0), blocks, samples).where("block_no = 0").count() == 0


def test_language_held_out(spark, data):
    """Fitted on 15 labelled sentences a language, tried on the others."""
    rows = spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("lang", "sample_no").collect()
    first = {}
    for r in rows:
        if r["sample_no"] <= 15:
            first[r["lang"]] = first.get(r["lang"], "") + " " + r["text"]
    c = language.Classifier(first)
    rest = [(r["lang"], c.language(r["text"])[0]) for r in rows if r["sample_no"] > 15]
    assert len(rest) == 60 and sum(a == b for a, b in rest) >= 58 and all(a == b for a, b in rest if b)
    assert c.language("12345 67")[0] is None and c.language("")[0] is None


def test_forms_undo_exactly():
    for w in ["été", "Größe", "l’eau", "“Übung”", "ação", "€"]:
        for f, chain, lost in encoding.forms(w):
            assert f != w
            if not lost and chain.startswith("utf-8>") and chain.count(">") in (1, 3):
                assert encoding.undo(f, chain) == w, (w, chain)


def test_garbled_blocks(spark):
    clean = "Der Wächter prüfte die Größe der Fässer für die Übung – “wie früher”. Später zählte er die Türen."
    twice = clean.encode().decode("latin-1").encode().decode("latin-1")
    rows = [(0, clean), (1, clean)]
    rows += [(2, clean.encode().decode("latin-1")), (3, twice), (4, clean.encode().decode("mac_roman")), (5, clean.encode().decode("cp437"))]
    rows += [(6, clean.encode("latin-1", "ignore").decode("utf-8", "replace")), (7, clean.encode("ascii", "replace").decode()), (8, "Is it? find?id=7 ok"), (9, None), (10, ""), (11, "plain text")]
    rows += [(12, "Der Wächter sah " + "die Größe der Türen".encode().decode("cp1252"))]
    blocks = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(0, clean, "x")] * 30, "block_id bigint, text string, outcome string")
    got = {r["block_id"]: r["outcome"] for r in encoding.garbled_blocks(blocks).collect()}
    assert got == {2: "whole", 3: "whole", 4: "whole", 5: "whole", 6: "lost", 7: "lost", 12: "whole"}
    back = {r["block_id"]: r["text"] for r in encoding.restored(blocks).collect()}
    assert back[2] == back[3] == back[4] == back[5] == clean and back[12] == "Der Wächter sah die Größe der Türen"
    assert encoding.garbled_blocks(blocks.limit(0)).count() == 0


def test_garbled_words_of_usual_letters(spark):
    clean = "Die Häuser der Straße, la información y los demás."
    garbled = ["Die Hõuser", "Die H„user", "der Straáe", "la informaciÛn"]
    blocks = spark.createDataFrame([(0, clean)] * 30 + list(enumerate(garbled, 1)), "block_id bigint, text string")
    assert {tuple(r) for r in encoding.garbled_blocks(blocks).collect()} == {(i, "whole") for i in range(1, 5)}
    back = {r["block_id"]: r["text"] for r in encoding.restored(blocks).collect()}
    assert back == {1: "Die Häuser", 2: "Die Häuser", 3: "der Straße", 4: "la información"}


def test_long_markup_inside_a_copy_is_no_gap():
    item = "the velpalith caravan left havriqet with twelve camels and reached savzekor after days without the grimovane guide"
    ix = leaks.ItemIndex([(1, item)])
    w = item.split()
    far = "https://example.test/" + "a" * 900
    for part in (f"[{w[8]}]({far})", f"[{w[8]}]({far}(b)c \"t\")", f'<a href="{far}" class="x">{w[8]}</a>', f"{w[8]} <!-- {'note ' * 200} -->", f"<{far}> {w[8]}"):
        found = ix.find(" ".join([*w[:8], part, *w[9:]]))
        assert [(f[0], f[1], f[2]) for f in found] == [(1, 17, 17)], part
    assert ix.find(" ".join(w[:8]) + " if a < b and c > d " + " ".join(w[8:]))[0][2] == 17


def test_markup_patterns_take_linear_time():
    import time

    for t in ("<!-- " * 40_000, "<a " + "b " * 200_000, "](" * 100_000, "<a b=" * 60_000, "](x(" * 60_000):
        began = time.time()
        leaks.stream(t)
        assert time.time() - began < 5


def test_several_blocks_of_items_are_taken_through_in_one_reading(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"q{r.randrange(400)}" for _ in range(20))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"x {items[i][1]} y {items[(i * 7) % 40][1]}") for i in range(40)], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, table).collect())
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, table, block_bytes=400, round_chars=300).collect()) == want


def test_short_words_other_scripts_and_pairs_of_encodings(spark):
    clean = "Là où il va, la rivière déborde. Łódź leży w Polsce, Žižek pisze książkę. Привет, новый мир. Die Größe zählt."
    twice = clean.encode().decode("cp437").encode().decode("cp850")
    rows = [(0, clean)] * 30 + [(1, "Привет, новый мир.".encode().decode("cp1251", "replace")), (2, "Łódź leży w Polsce".encode().decode("latin-1")), (3, twice), (4, "Là où il va, la rivière déborde.".encode("cp1252").decode("mac_roman")), (5, "là, où")]
    blocks = spark.createDataFrame(rows, "block_id bigint, text string")
    got = {r["block_id"]: r["outcome"] for r in encoding.garbled_blocks(blocks).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == got[4] == "whole"
    back = {r["block_id"]: r["text"] for r in encoding.restored(blocks).collect()}
    assert back[2] == "Łódź leży w Polsce" and back[3] == clean and back[4] == "Là où il va, la rivière déborde."


def test_clean_words_of_one_script():
    for w in ("Łódź", "Žižek", "Привет", "où", "là", "ΑΘΗΝΑ", "Größe", "l’eau", "“Übung”", "日本"):
        assert encoding.CLEAN.match(w), w
    for w in ("FlΘche", "Straﬂe".replace("ﬂ", "▀"), "gro├ƒe", "cafÃ©", "РџСЂ"):
        assert not encoding.CLEAN.match(w), w

"""Training-data operators: defined results for edge cases, brute force, round trips."""

import random
from collections import Counter

import pytest

pytest.importorskip("folioloom.llm")

from folioloom.llm import encoding, lookalikes, mixing, packing, scans, splitting
from folioloom.llm.tokens import encoder

NODES = (
    "doc_id bigint, id string, node_type string, text_order int, content struct<text:string>, style_info struct<font_size:float>, "
    "location struct<physical:struct<page:int,bounding_box:struct<x:float,y:float,width:float,height:float>>>"
)
META = "doc_id bigint, root_id string, document_type string, title string"


def node(doc, i, text, kind="Paragraph", order=0, size=10.0, y=100.0):
    return (doc, i, kind, order, (text,), (size,), ((1, (72.0, y, 400.0, 12.0)),))


# -- look-alikes


def test_equal_looking_texts_pair_and_others_do_not(spark):
    rows = [
        node(1, "a", "Résumé of scope"), node(1, "b", "Résumé оf sc​ope"), node(1, "c", "Ｒésumé of scope"), node(1, "d", "Resume of scope"),
        node(1, "e", "Résumé of Scope"), node(2, "f", "Résumé оf scope"), node(1, "g", None), node(1, "h", ""), node(1, "i", "m²"), node(1, "j", "m2"), node(1, "k", "a–b"), node(1, "l", "a-b"), node(1, "m", "a‐b"),
    ]
    n = spark.createDataFrame(rows + rows[:2] + [node(1, None, "Résumé of scope")], NODES)
    md = spark.createDataFrame([(1, "x", "G", "Title"), (2, "y", "G", "Тitle"), (3, "z", "G", None), (4, None, "G", "Title")], META)
    got = sorted(map(tuple, lookalikes.pairs(n, md).collect()))
    assert got == [("text", "a", "b"), ("text", "a", "c"), ("text", "b", "c"), ("text", "l", "m"), ("title", "x", "y")]


def test_canonical_spelling_follows_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "дом сад"), (2, "дoм"), (3, "house"), (4, "hоuse hоuze"), (5, None), (6, ""), (7, "ﬁne x　y")], "id bigint, text string")
    got = {r.id: r.canonical for r in lookalikes.canonical_texts(df, ["id"]).collect()}
    assert got == {1: "дом сад", 2: "дом", 3: "house", 4: "house houze", 5: None, 6: "", 7: "fine x y"}


def test_lookalikes_empty_tables_and_long_tokens(spark):
    assert lookalikes.pairs(spark.createDataFrame([], NODES), spark.createDataFrame([], META)).count() == 0
    long = "ж" * 5000
    df = spark.createDataFrame([(1, long), (2, long + "​")], "id bigint, text string")
    assert len({r.canonical for r in lookalikes.canonical_texts(df, ["id"]).collect()}) == 1


def weighted(a, b):
    """The edit cost of two texts by brute force: classes for characters, ignorables free."""
    import unicodedata

    a, b = (unicodedata.normalize("NFD", lookalikes.skeleton(x)) for x in (a, b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bound", [0, 1, 2])
def test_automaton_equals_brute_force(bound):
    rng = random.Random(3)
    alphabet = "aаoоcсxхé\u0301e\u200bn"
    vocab = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(200)})
    trie = lookalikes.Trie()
    for v in vocab:
        trie.add(v, 1)
    for t in vocab:
        assert {v for v in vocab if weighted(v, t) <= bound} == {s for _, s in trie.reach(t, bound)}, t


def test_ligatures_are_read_at_no_cost():
    trie = lookalikes.Trie()
    for v in ("fine", "ﬁne", "f\u200bine", "fune", "fin"):
        trie.add(v, 1)
    assert {s for _, s in trie.reach("ﬁ\u00adne")} == {"fine", "ﬁne", "f\u200bine"}


def test_shards_hold_all_that_a_search_of_the_whole_vocabulary_reaches(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aаoоcсpрeеxх") for _ in range(rng.randint(1, 5))) for _ in range(600)]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    trie = lookalikes.Trie()
    for w, n in Counter(words).items():
        if lookalikes.clean(w):
            trie.add(w, n)
    want = {w: c for w in set(words) if not w.isascii() and (c := lookalikes.canonical_spelling(w, trie)) != w}
    assert {r.token: r.canonical for r in lookalikes.spellings(df).collect()} == want


def test_a_look_of_many_rows_is_spread_and_has_classes(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "PAIRED", 7)
    rows = [node(1, f"a{i:02}", "Scope") for i in range(20)] + [node(1, f"b{i:02}", "Sсope") for i in range(20)] + [node(1, "c", "Other")]
    n, md = spark.createDataFrame(rows, NODES), spark.createDataFrame([], META)
    assert sorted((r.id_a, r.id_b) for r in lookalikes.pairs(n, md).collect()) == sorted((f"a{i:02}", f"b{j:02}") for i in range(20) for j in range(20))
    got = lookalikes.memberships(n, md).collect()
    assert len(got) == 40 and {r.class_id for r in got} == {"a00"} and len({r.spelling for r in got}) == 2


# -- scans


def scan_rows():
    body = "The steady reservoir governs the catalogue beside the water and the\nlong-\nterm gauge re-\ncords the valve. b0th fixfures were surveyed\nFERU TILE | 2\nbefore the reser-"
    rows = [node(1, "a", body, order=1), node(1, "f", "FERU TILE | 3", order=2, size=8.0, y=20.0), node(1, "b", "voir was drained and the\ncatalogue was restored over many of the long lines here and there.", order=3)]
    plain = "The reservoir and both fixtures were surveyed; the long-term valve records the water. "
    rows += [node(2, f"p{i}", plain * 4, order=i) for i in range(5)]
    return rows


def test_defects_of_scans(spark):
    n = spark.createDataFrame(scan_rows() + scan_rows()[:1], NODES)
    md = spark.createDataFrame([(1, "x", "G", None), (2, "y", "G", None)], META)
    s = scans.Scans(n, md)
    assert sorted(map(tuple, s.defects().collect())) == [("a", "broken_word"), ("a", "inline_furniture"), ("a", "misread"), ("f", "furniture")]
    text = {r.node_id: r.text for r in s.repaired().collect()}
    assert "long-term gauge records the valve. both fixtures were surveyed before the reservoir" in text["a"] and text["b"].startswith("was drained") and "f" not in text


def test_scans_whose_lines_run_together(spark):
    """No line feed tells: cuts, heads and misreads are found inside the text, compounds and clean documents are left alone."""
    one = [
        node(3, "u", "The reser- voir and both fix- FERU TILE | 4 tures were surveyed beside the long- term valve with upper- and lower records of the wafer.", order=1),
        node(3, "v", "The village at Tures surveyed the Report on the Vale Nuno water  7 reservoir while both fixtures were sur- Report on the Vale Nuno water veyed.", order=2),
        node(3, "h", "FERU TILE | 5", order=3, size=8.0, y=20.0), node(3, "l", "Valves record the reservoir. Fhe fixtures were surveyed by Fhe beside it.", "ListItem", order=4),
    ]
    clean = "The reservoir and both fixtures were surveyed; the long-term valve records the water. The reservoir was surveyed and upper water and lower water. "
    rows = one + one[:1] + [node(4, f"c{i}", clean * 4 + "See [3] and 12  parts with upper- and lower valves.", order=i) for i in range(5)]
    md = spark.createDataFrame([(3, "x", "G", "Report on the Vale Nuno water"), (4, "y", "G", None)], META)
    s = scans.Scans(spark.createDataFrame(rows, NODES), md)
    assert sorted(map(tuple, s.defects().collect())) == [("h", "furniture"), ("l", "misread"), ("u", "broken_word"), ("u", "inline_furniture"), ("u", "misread"), ("v", "broken_word"), ("v", "inline_furniture")]
    text = {r.node_id: r.text for r in s.repaired().collect()}
    assert text["u"] == "The reservoir and both fixtures were surveyed beside the long-term valve with upper- and lower records of the water."
    assert text["v"] == "The village at Tures surveyed the reservoir while both fixtures were surveyed."
    assert text["l"] == "Valves record the reservoir. The fixtures were surveyed by Fhe beside it." and "h" not in text


def test_scans_take_null_documents_extra_columns_and_long_texts(spark):
    rows = [(*node(3, f"x{i}", t, order=o), "z") for i, (t, o) in enumerate([("word " * 40_000, 1), ("re- " * 3000, None), ("\n" * 500, 2), ("a\n" * 2000 + "b-", 3), ("-", 4)])]
    n = spark.createDataFrame(rows + [(*node(None, "y", "cut re-\nservoir"), "z")], NODES + ", mask string")
    assert scans.Scans(n, spark.createDataFrame([(3, "x", "G", ""), (None, "y", "G", "T")], META)).repaired().count() >= 0


def test_both_sides_of_a_confusion_share_a_skeleton(spark):
    pairs = [p.split(" ") for p in scans.CONFUSIONS.split(", ")]
    df = spark.createDataFrame([(f"xx{t}yy", f"xx{s}yy") for t, s in pairs], "true string, seen string")
    rows = df.select("true", "seen", (scans.skeleton(scans.F.col("seen")) == scans.skeleton(scans.F.col("true"))).alias("met")).collect()
    assert all(r.met for r in rows), [r for r in rows if not r.met]


def test_scans_without_rows_texts_or_wraps(spark):
    md = spark.createDataFrame([(1, "x", "G", None)], META)
    assert scans.Scans(spark.createDataFrame([], NODES), md).defects().count() == 0
    rows = [node(1, "a", None), node(1, "b", ""), node(1, "c", "word " * 60), node(None, "d", "x\ny"), node(1, None, "x\ny")]
    assert scans.Scans(spark.createDataFrame(rows, NODES), md).defects().count() == 0


@pytest.mark.parametrize("seen,true,cost", [("b0th", "both", 1), ("duririg", "during", 1), ("durmg", "during", 1), ("fhc", "the", 2), ("cat", "dog", None), ("both", "both", 0), ("shelterecl", "sheltered", 1)])
def test_confusions(seen, true, cost):
    assert scans.confusions_between(seen, true) == cost


# -- splitting


def test_pieces_keep_text_limits_and_overlaps():
    rng = random.Random(8)
    words = ["alpha", "Straße", "水路。", "x" * 70, "end. ", "\n\n", "a, b"]
    for _ in range(150):
        data = " ".join(rng.choice(words) for _ in range(rng.randint(0, 900))).encode()
        most, overlap = rng.choice([1, 2, 7, 40, 120]), rng.choice([0, 1, 15, 60])
        cut = splitting.cuts(data, most, overlap)
        assert b"".join(data[n:e] for _, n, e in cut) == data
        for k, (s, n, e) in enumerate(cut):
            data[s:e].decode()
            assert (e - s) // 4 <= most
            assert (n - s) // 4 == (min(overlap, most // 2) if k else 0)
        assert (len(cut) > 1) == (len(data) // 4 > most)


def test_an_edit_alters_neighbours_only():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", ".", ","]) for _ in range(8000)).encode()
    edited = text[:9000] + b"some new words. " + text[9000:]
    a = [text[n:e] for _, n, e in splitting.cuts(text, 400, 40)]
    b = [edited[n:e] for _, n, e in splitting.cuts(edited, 400, 40)]
    assert sum((Counter(a) - Counter(b)).values()) <= 6


def test_split_nodes_edge_cases(spark):
    rows = [node(1, "a", "word " * 300), node(1, "b", "short"), node(1, "c", None), node(1, "d", ""), node(2, "e", "word " * 300), node(1, "f", "word " * 300, "Figure"), node(1, None, "x")]
    n = spark.createDataFrame(rows + rows[:1], NODES)
    md = spark.createDataFrame([(1, "x", "G", None), (1, "x", "G", None), (3, "z", "G", None)], META)
    limits = spark.createDataFrame([("G", "Paragraph", 40, 500), ("G", "Paragraph", 90, 1), ("G", "ListItem", 0, 1)], "document_type string, node_type string, max_tokens int, overlap_tokens int")
    got = splitting.split_nodes(n, md, limits).collect()
    pieces = Counter(r.node_id for r in got)
    assert pieces["a"] > 1 and all(pieces[k] == 1 for k in "bdef") and "c" not in pieces
    assert all(r.tokens <= 40 for r in got if r.node_id == "a") and {r.max_tokens for r in got if r.node_id == "a"} == {40}
    assert splitting.split_nodes(spark.createDataFrame([], NODES), md, limits).count() == 0


# -- packing and mixing


def test_plan_is_a_packing_and_near_the_bound():
    rng = random.Random(5)
    for capacity, n in ((10, 40), (512, 3000), (100, 0), (100, 1)):
        items = [min(capacity, max(0, int(rng.lognormvariate(0, 1) * capacity / 5))) for _ in range(n)]
        runs, bins = packing.plan(Counter(items), capacity)
        load, placed = Counter(), Counter()
        for size, start, many, each, first in runs:
            assert placed[size] == start
            placed[size] += many * each
            for k in range(many):
                load[first + k] += size * each
        assert +placed == +Counter(items) and all(v <= capacity for v in load.values())
        large = sum(2 * s > capacity for s in items)
        assert bins <= max(large, 1.2 * sum(items) / capacity) + 2
        # at most two large items a container
        big = Counter()
        for size, _, many, each, first in runs:
            if 3 * size > capacity:
                for k in range(many):
                    big[first + k] += each
        assert all(v <= 2 for v in big.values())


def test_pack_whole_and_large_texts(spark):
    big = "many different words stand here " * 40
    rows = [(1, big, "s"), (2, "tiny", "s"), (2, "tiny", "s"), (3, None, "s"), (4, "", "s"), (5, "a b c d e", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    packs = spark.createDataFrame([("p", 16), ("p", 16), ("q", None), ("r", 0)], "pack_name string, capacity_tokens int")
    got = packing.pack(docs, packs).collect()
    size = {i: len(encoder().encode_ordinary(t)) for i, t, _ in rows if t is not None}
    load = Counter()
    for r in got:
        load[r.container] += r.tokens
    assert max(load.values()) <= 16 and {r.pack_name for r in got} == {"p"}
    assert sum(r.tokens for r in got if r.doc_id == 1) == size[1] and sum(1 for r in got if r.doc_id == 2) == 2
    assert [r.tokens for r in got if r.doc_id == 4] == [0] and not [r for r in got if r.doc_id == 3]
    assert packing.pack(docs.limit(0), packs).count() == 0 and packing.pack(docs, packs.limit(0)).count() == 0
    report = packing.fill_report(packing.pack(docs, packs), packs).first()
    assert report.containers >= report.containers_at_least


def test_mix_reaches_shares_within_repeats(spark):
    rows = [(i, "word " * (1 + i % 7), "a" if i % 3 else "b", "x") for i in range(3000)] + [(9001, None, "a", "x"), (9002, "", "a", "x"), (9003, "w", None, "x"), (9004, "w", "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3), (None, 0.1, 3), ("zero", None, None)], "source string, target_share double, max_repeats int")
    records, shares = mixing.mix(docs, targets)
    s = {r.source: r for r in shares.collect()}
    total = s["a"].available_tokens + s["b"].available_tokens
    assert set(s) == {"a", "b", "none", "zero"} and s["none"].used_tokens == 0 and s["none"].short
    assert abs(s["a"].used_tokens / total - 0.5) < 0.01 and abs(s["b"].used_tokens / total - 0.4) < 0.01
    used = Counter((r.source, r.doc_id) for r in records.collect())
    assert max(v for (k, _), v in used.items() if k == "a") == 1 and max(v for (k, _), v in used.items() if k == "b") <= 2
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


# -- encodings


def garbled_corpus():
    rng = random.Random(6)
    french = "le modèle vérifié où la façade est créée après l'été à côté du bâtiment".split()
    russian = "новый журнал проверка станция значение изменение добавить ошибка канал".split()
    docs = {}
    for i in range(400):
        words = french if i % 2 else russian
        docs[i] = " ".join(rng.choice(words) for _ in range(30))
    return docs


@pytest.mark.parametrize("wrong,right,of", [("cp1252", "utf-8", 1), ("latin-1", "utf-8", 0), ("cp1251", "utf-8", 1), ("cp437", "utf-8", 0), ("mac-roman", "utf-8", 1), ("latin-1", "cp1251", 0), ("cp1251", "koi8-r", 0)])
def test_restores_exactly(spark, wrong, right, of):
    docs = garbled_corpus()
    good = docs[of]
    bad = "".join(encoding._byte_chars(wrong)[b] if b > 127 else chr(b) for b in good.encode(right))
    df = spark.createDataFrame([*docs.items(), (1000, bad)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in encoding.affected(df).collect()}
    assert got == {1000: good}


def test_correct_text_is_no_case(spark):
    docs = garbled_corpus()
    fine = ["Tiếng Việt: Ã ã Â â", "ATENÇÃO: NÃO REMOVER", "ROMÂNĂ: ÎNTÂI", "½ × ¾ ≈ ⅜", "├──┼──┤", "\\u00e9 &eacute; =C3=A9", "日本語の文章", "“quoted” – 5 € µs", "", None]
    df = spark.createDataFrame([*docs.items(), *((2000 + i, t) for i, t in enumerate(fine)), (3000, "caf�")], "doc_id bigint, text string")
    assert [(r.doc_id, r.lost, r.text) for r in encoding.affected(df).collect()] == [(3000, True, "caf�")]
    assert encoding.affected(df.limit(0)).count() == 0


def test_twice_garbled_and_repeated_rows(spark):
    docs = garbled_corpus()
    bad = "été créé à côté"
    for _ in range(2):
        bad = "".join(encoding._byte_chars("cp1252")[b] if b > 127 else chr(b) for b in bad.encode())
    df = spark.createDataFrame([*docs.items(), (1000, bad), (1000, bad)], "doc_id bigint, text string")
    assert [r.text for r in encoding.affected(df).collect()] == ["été créé à côté"] * 2


def test_shares_of_mutual_information_equal_brute_force(spark):
    import math

    texts = ["abab cab", "ébé\nab", "", None]
    bits, single, mean = encoding.information(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1))
    whole = "\n".join(["", *(t for t in texts if t), ""])
    pairs, chars = Counter(zip(whole, whole[1:])), Counter(whole)
    n, m = sum(pairs.values()), sum(chars.values())

    def share(a, b):
        p = pairs[a, b] / n
        return -math.log2(p) - math.log2(min(max(math.log2(p / (chars[a] / m * chars[b] / m)), encoding.LEAST_PMI), encoding.MOST_PMI))

    got = encoding.Pairs(bits, single)
    assert all(abs(got[p] - share(*p)) < 1e-4 for p in pairs)
    assert abs(mean - sum(k * share(*p) for p, k in pairs.items()) / n) < 1e-4

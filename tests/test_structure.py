"""Document-structure operators against brute force and hand-made edge rows."""

import json
import random

from pyspark.sql import functions as F

from folioloom.config import Clustering, Lists, Rule, Sizing, for_document_type, load, preset
from folioloom.functions.blocks import before, previous
from folioloom.functions.ranks import ranked
from folioloom.operators import clustering, lists, navigate, profile, sizing, tree, typography, validate
from folioloom.operators.elements import parsed
from folioloom.operators.headings import next_level
from folioloom.plans import formats
from folioloom.plans.pipeline import Pipeline
from folioloom.sources import markup

TE = (
    "doc_id bigint, text string, style_info struct<class_name:string,font_family:string,font_size:float,font_style:string,font_weight:string,color:string>, "
    "bounding_box struct<x:float,y:float,width:float,height:float>, page_number int, paragraph_number int, line_number int, segment_number int, reading_order int, "
    "bookmark_match struct<title:string,order:int>, token_count bigint"
)
BODY, HEAD = ("f0", "Serif", 10.0, "normal", "normal", "#000"), ("f1", "Sans", 20.0, "normal", "bold", "#000")


def element(doc, ro, text, style=BODY, page=1, para=None, y=None, w=100.0):
    return (doc, text, style, (72.0, float(ro * 20 if y is None else y), w, 12.0), page, ro if para is None else para, 0, 0, ro, None, len((text or "").encode()) // 4)


def test_levels_of_headings():
    c = preset("cli").headings
    out, level, last, fonts = [], 1, None, []
    for size in (20, 16, 20, 13, 12.95):
        level = next_level(level, last, fonts, size, c)
        last = size
        out.append(level)
    assert out == [1, 2, 1, 2, 3]


def test_before_and_previous_cross_blocks(spark):
    n = 10_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("o"), (F.col("id") % 3).alias("v"))
    got = {r.o: (r.s, r.prev_v) for r in previous(before(df, ["k"], "o", F.col("v"), "s"), ["k"], "o", ["v"]).collect()}
    total = 0
    for o in range(n):
        assert got[o] == (total, None if o == 0 else (o - 1) % 3)
        total += o % 3


def test_ranks_are_a_bijection(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("a")).alias("g"), "id")
    rows = ranked(df, ["g"], ["id"], 7).collect()
    for g in (None, "a"):
        ranks = sorted(r["rank"] for r in rows if r.g == g)
        assert ranks == list(range(len(ranks)))


def brute_tree(rows):
    """(parent order, path) of (type, level) rows by a plain stack."""
    stack, kids, path, out = [(-1, 0)], {-1: 0}, {-1: ""}, []
    for i, (kind, level) in enumerate(rows):
        if level <= 1:
            del stack[1:]
        else:
            while len(stack) > level:
                stack.pop()
        top = stack[-1][0]
        kids[top] += 1
        path[i] = f"{path[top]}.{kids[top]}" if path[top] else str(kids[top])
        kids[i] = 0
        out.append((top, path[i]))
        if kind == "Section":
            while len(stack) > 1 and stack[-1][1] >= level:
                stack.pop()
            stack.append((i, level))
    return out


def test_tree_is_the_stack_rule(spark):
    rng = random.Random(4)
    docs = {d: [(rng.choice(["Section", "Paragraph"]), rng.randint(1, 5)) for _ in range(rng.randint(1, 60))] for d in range(12)}
    docs[99] = [("Section", 1), ("Section", 3), ("Section", 3)]
    rows = [(d, k, "t", lv, 1, i) for d, v in docs.items() for i, (k, lv) in enumerate(v)]
    df = spark.createDataFrame(rows, "doc_id bigint, element_type string, text string, hierarchy_level int, page_number int, reading_order int")
    got = {(r.doc_id, r.text_order): (r.parent_order, r.path) for r in tree.placed(df).collect()}
    assert got == {(d, i): p for d, v in docs.items() for i, p in enumerate(brute_tree(v))}
    assert got[(99, 2)][0] == 1


def brute_merge(rows, c):
    out = []
    for text, box in rows:
        if out and len(out[-1][0].encode()) + len(text.encode()) + 1 <= c.max_paragraph_size and clustering.adjacent(out[-1][1], box, c):
            out[-1] = (out[-1][0] + " " + text, clustering.union(out[-1][1], box))
        else:
            out.append((text, box))
    return out


def test_neighbours_merge_greedily(spark):
    rng = random.Random(1)
    c = Clustering(True, True, 8.0, 1.0, 15.0, 300, 40)
    rows = [(f"w{i}" + "é" * rng.randint(0, 6), (float(rng.choice([72, 90])), float(i * rng.choice([12, 30])), 100.0, 12.0)) for i in range(40)]
    df = parsed(spark.createDataFrame([(1, t, BODY, b, 1, i, 0, 0, i, None, 1) for i, (t, b) in enumerate(rows)], TE))
    got = [(r.text, tuple(r.bounding_box)) for r in clustering.merge_neighbours(df, c).orderBy("reading_order").collect()]
    assert got == brute_merge(rows, c)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1, "a", "P", 1, v) for v in range(11)] + [(2, "a", "P", 1, 5), (2, "b", "P", 1, 5)], "doc_id bigint, id string, node_type string, depth int, token_count bigint")
    h = profile.histograms(df).filter("overall").collect()
    assert sorted(r["count"] for r in h if r.doc_id == 1) == [1] * 10
    assert [(r.range_start, r.range_end, r["count"]) for r in h if r.doc_id == 2] == [(5, 6, 2)]
    s = {r.doc_id: r for r in profile.token_statistics(df).filter("overall").collect()}
    assert s[1].mode == 9 and s[1].median == 5 and s[2].variance == 0


def test_lists_are_validated(spark):
    good = [("1. a", "2. b"), ("- x", "- y")]
    bad = [("1. a", "7. b"), ("i. a", "ii. b"), ("- 5", "- 6"), ("(2) a", "(3) b"), ("2. a", "3. b"), ("1. a",)]
    # an item takes the elements up to the next marker; what lies too far from the last marker stays
    mixed = ("head", "1. a", "more", "2. b", "tail")
    rows = [element(d, i, t) for d, texts in enumerate([*good, *bad, mixed]) for i, t in enumerate(texts)]
    found = lists.detect_lists(parsed(spark.createDataFrame(rows, TE)), Lists()).orderBy("reading_order").collect()
    got = {d: [(r.element_type, r.text) for r in found if r.doc_id == d] for d in range(9)}
    for d, texts in enumerate(good):
        assert got[d] == [("List", "\n".join(texts))]
    for d, texts in enumerate(bad, len(good)):
        assert got[d] == [("Paragraph", t) for t in texts]
    assert got[8] == [("Paragraph", "head"), ("List", "1. a more\n2. b"), ("Paragraph", "tail")]


def test_sizes_are_enforced(spark):
    c = Sizing(max_size=40, min_size_ratio=0.1)
    text = "One sentence here. Another sentence there! " * 5
    p = parsed(spark.createDataFrame([element(1, 0, text), element(1, 1, "short"), element(1, 2, "x" * 100)], TE))
    rows = sizing.enforce(p, c).collect()
    assert all(len(r.text) <= 40 for r in rows) and sum(r.text == "short" for r in rows) == 1
    assert "".join(sorted(r.text for r in rows if "x" in r.text)) == "x" * 100


def test_validation_issues(spark):
    rows = [element(1, 0, "a"), element(1, 20, "b"), element(1, 21, "c", page=9), element(1, 22, "d", page=0), element(1, 23, "e", w=0.0)]
    got = sorted((r.issue, r.reading_order) for r in validate.issues(parsed(spark.createDataFrame(rows, TE)), 5).collect())
    assert got == [("invalid_box", 23), ("page_jump", 21), ("page_zero", 22), ("reading_order", 20)]


def test_pipeline_validates_ruled_elements(spark):
    sizes = (30.0, 28.0, 26.0, 24.0, 22.0, 20.0)
    heads = [element(1, i, "x" * 201 if i == 0 else f"Heading of size {size}", ("f1", "Sans", size, "normal", "bold", "#000"), y=i * 200) for i, size in enumerate(sizes)]
    # below a heading of level 6 lies level 7; page 2 comes last, though it is read before page 1's last element
    rows = [*heads, element(1, 6, "body text", page=2), element(1, 7, "more text", y=2000)]
    te = spark.createDataFrame(rows, TE)
    fc = spark.createDataFrame([(1, *HEAD), (1, *BODY)], "doc_id bigint, class_name string, font_family string, font_size float, font_style string, font_weight string, color string")
    c = preset("cli")
    c.rules = [*c.rules, Rule("Validation")]
    p = Pipeline(te, fc, None, c)
    assert sorted((r.issue, r.reading_order) for r in p.issues.collect()) == [("long_section", 0), ("orphaned_element", 6), ("orphaned_element", 7)]
    assert [(r.elements, r.issues, r.score) for r in p.quality.collect()] == [(8, 3, 0.625)]
    # validated before any rule, the same elements are all paragraphs of level 1
    c.rules = [Rule("Validation")]
    assert Pipeline(te, fc, None, c).issues.count() == 0
    # every check fires, and only by (page, reading order) does the level jump
    p = [(1, "Paragraph", "a", 1, 0, 0, 1.0), (1, "Section", "ab", 7, 0, 40, 1.0), (1, "Section", "x" * 201, 3, 9, 2, 0.0)]
    df = spark.createDataFrame(p, "doc_id bigint, element_type string, text string, hierarchy_level int, page_number int, reading_order int, w float")
    df = df.withColumn("bounding_box", F.expr("named_struct('x', w, 'y', w, 'width', w, 'height', w)"))
    got = sorted((r.issue, r.reading_order) for r in validate.issues(df, 6, by_page=True).collect())
    assert got == [("hierarchy_jump", 40), ("invalid_box", 2), ("long_section", 2), ("orphaned_element", 40), ("page_jump", 2), ("page_zero", 0), ("page_zero", 40), ("reading_order", 2), ("reading_order", 40), ("short_section", 40)]


def test_markup_round_trip_and_defects(spark):
    rows = [element(1, 0, "Head", HEAD), element(1, 1, "naïve é", page=2), element(1, 2, "b", page=2)]
    te = spark.createDataFrame(rows, TE)
    classes = spark.createDataFrame([(1, *HEAD), (1, *BODY)], "doc_id bigint, class_name string, font_family string, font_size float, font_style string, font_weight string, color string")
    back = markup.text_elements(markup.build(te, classes)).orderBy("reading_order").collect()
    assert [(r.text, r.style_info.font_size, r.page_number, r.token_count) for r in back] == [("Head", 20.0, 1, 1), ("naïve é", 10.0, 2, 2), ("b", 10.0, 2, 0)]
    bad = '<div class="page"><p><span class="f1" data-bbox="1,2,3" data-line="1" data-segment="1">x</span><span class="f9" data-bbox="1,2,3,4" data-line="q" data-segment="1"> y </span></p></div><ul><li> y </li></ul>'
    one = markup.text_elements(spark.createDataFrame([(1, bad), (2, None), (3, "")], "doc_id bigint, xhtml string")).collect()
    assert [(r.text, r.style_info.font_family, r.line_number, r.bookmark_match.order) for r in one] == [("y", "unknown", 0, 0)]


def test_pipeline_invariants(spark):
    rows = []
    for d in (1, 2):
        ro = 0
        for k in range(4):
            rows.append(element(d, ro, f"Heading number {k}", HEAD))
            ro += 1
            for j in range(5):
                rows.append(element(d, ro, f"body text {k} {j} " * 10, para=ro // 2 + 100, page=1 + k // 2))
                ro += 1
    rows.append(rows[3])
    te = spark.createDataFrame(rows, TE)
    fc = spark.createDataFrame([(d, *s) for d in (1, 2) for s in (HEAD, BODY)], "doc_id bigint, class_name string, font_family string, font_size float, font_style string, font_weight string, color string")
    md = spark.createDataFrame([(1, "Given"), (2, None)], "doc_id bigint, title string")
    p = Pipeline(te, fc, md)
    counts = {r.stage: r.n for r in p.stage_counts().collect()}
    assert counts["text_elements"] == 48 and counts["graph_nodes"] == counts["parsed_elements"] + 2
    roots = navigate.roots(p.nodes).collect()
    assert {r.doc_id: r.location.semantic.breadcrumbs for r in roots} == {1: ["Given"], 2: ["Heading number 0"]}
    kids = {(r.doc_id, r.id): r.children for r in p.nodes.collect()}
    for r in p.nodes.collect():
        assert r.parent is None or r.id in kids[(r.doc_id, r.parent)]
        assert len(r.location.semantic.breadcrumbs) <= r.location.semantic.depth + 2
    assert p.profile.count() == 2
    assert formats.graph(p.nodes).filter(F.try_parse_json("json").isNull()).count() == 0
    assert formats.uncached(md.select(F.lit("a").alias("cache_hash")), md.select(F.lit("a").alias("cache_hash"))).count() == 0


def test_formats_are_whole(spark):
    ddl = "doc_id bigint, id string, node_type string, location struct<semantic:struct<path:string,depth:int,breadcrumbs:array<string>>,physical:struct<page:int,bounding_box:struct<x:float,y:float,width:float,height:float>>>, text_order int, content struct<text:string>, style_info struct<font_class:string,font_size:float>, token_count bigint, parent string, children array<string>"
    box = (1.0, 2.0, 3.0, 4.0)
    rows = [
        (1, "p", "Paragraph", (("1.1", 2, ["S"]), (1, box)), 1, ("text",), None, 4, "s", []),
        (1, "r", "Document", (("", 0, []), None), None, ("Document",), None, 0, None, ["s"]),
        (1, "s", "Section", (("1", 1, ["S"]), (1, box)), 0, ("S",), ("f1", 20.0), 1, "r", ["p"]),
    ]
    n = spark.createDataFrame(rows, ddl)
    hist = lambda v: {"bins": [{"range_start": v, "range_end": v + 1, "count": 1, "token_sum": v}], "total_count": 1, "total_tokens": v, "mean": v, "median": v, "mode": v, "variance": 0}
    bins = [{"range_start": k, "range_end": k + 1, "count": int(k < 2), "token_sum": int(k == 1)} for k in range(4)]
    profiled = {
        "created_at": "now", "document_type": "Generic", "flow_type": "Fixed", "total_nodes": 3, "total_tokens": 5,
        "token_distribution": {
            "by_node_type": {"Document": hist(0), "Section": hist(1), "Paragraph": hist(4)},
            "overall": {"bins": bins, "total_count": 3, "total_tokens": 5, "mean": 1.6667, "median": 1, "mode": 1, "variance": 4.3333},
        },
        "node_type_distribution": {"counts": {"Document": 1, "Section": 1, "Paragraph": 1}, "percentages": {"Document": 33.3333, "Section": 33.3333, "Paragraph": 33.3333}},
        "depth_distribution": {"max_depth": 2, "depth_counts": {"0": 1, "1": 1, "2": 1}, "avg_depth": 1},
    }
    load = lambda text: json.loads(text, parse_float=lambda x: round(float(x), 4))
    md = spark.createDataFrame([(1, None, "A", 3, True)] * 2, "doc_id bigint, title string, author string, page_count int, encrypted boolean")
    md = md.select("*", *[F.lit(None).cast("string").alias(c) for c in formats.METADATA if c not in md.columns])
    info = formats.metadata(md, tree.merge_titles(n.select("doc_id", F.col("node_type").alias("element_type"), F.col("content.text").alias("text"), F.lit(0).alias("page_number"), F.col("text_order").alias("reading_order")), md))
    te = spark.createDataFrame([element(1, 0, "S", HEAD), element(1, 1, "te"), element(1, 2, "xt")], TE)
    g = load(formats.graph(n, info, typography.document_analysis(te), F.lit("now")).first().json)
    assert g["structural_profile"] == profiled and [x["id"] for x in g["nodes"]] == ["r", "s", "p"]
    assert g["document_info"]["document_metadata"] == dict.fromkeys(formats.METADATA) | {"title": "S", "author": "A", "page_count": 3, "encrypted": True}
    a = g["document_info"]["document_analysis"]
    assert (a["all_font_sizes"], a["bold_counts"], a["font_size_counts"], a["most_common_font_family"]) == ([10, 10, 20], [1, 2], {"10.0": 2, "20.0": 1}, "Serif")
    q = formats.sequential_documents(n, F.lit("now"))
    q = load(q.select(F.to_json(F.struct("format", "segments", "structural_profile"), {"ignoreNullFields": "false"})).first()[0])
    place = lambda path, depth, crumbs: {"path": path, "depth": depth, "breadcrumbs": crumbs}
    at = {"page": 1, "bounding_box": {"x": 1, "y": 2, "width": 3, "height": 4}}
    assert q == {"format": "sequential", "structural_profile": profiled, "segments": [
        {"id": 0, "node_type": "Document", "text": "Document", "location": {"semantic": place("", 0, []), "physical": None}, "style": None, "tokens": 0},
        {"id": 1, "node_type": "Section", "text": "S", "location": {"semantic": place("1", 1, ["S"]), "physical": at}, "style": {"font_class": "f1", "font_size": 20}, "tokens": 1},
        {"id": 2, "node_type": "Paragraph", "text": "text", "location": {"semantic": place("1.1", 2, ["S"]), "physical": at}, "style": None, "tokens": 4},
    ]}


def test_render(spark):
    ddl = "doc_id bigint, id string, node_type string, location struct<semantic:struct<path:string,depth:int,breadcrumbs:array<string>>,physical:struct<page:int>>, text_order int, content struct<text:string>, token_count bigint, parent string, children array<string>"
    rows = [
        (1, "r", "Document", (("", 0, ["T"]), None), None, ("Document",), 0, None, ["s"]),
        (1, "s", "Section", (("1", 1, ["T", "S"]), (1,)), 0, ("S",), 1, "r", ["p"]),
        (1, "p", "Paragraph", (("1.1", 2, ["T", "S"]), (1,)), 1, ("text",), 1, "s", []),
    ]
    n = spark.createDataFrame(rows, ddl)
    flat = profile.flat_nodes(n)
    show = lambda **k: navigate.render(n, flat, navigate.roots(flat), **k).first().text
    assert show() == "Document\n\nS\n\ntext"
    assert show(node_types=True) == "[Document] Document\n\n[Section] S\n\n[Paragraph] text"
    assert show(breadcrumbs=True) == "[T]\n\n[T > S]\n\ntext"
    assert show(breadcrumbs=True, node_types=True) == "[Document | T]\n\n[Section | T > S]\n\n[Paragraph] text"


def test_configs(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("headings:\n  min_header_size: 12\n  section_patterns:\nrules:\n  - SectionDetection\n  - {name: Validation, enabled: false}\n")
    c = load(str(f))
    assert c.headings.min_header_size == 12.0 and [(r.name, r.enabled) for r in c.rules] == [("SectionDetection", True), ("Validation", False)]
    assert for_document_type("Legal").headings.section_patterns[0] == "article" and len(for_document_type("x").headings.section_patterns) == 8
    assert preset("cli").hash() != preset("library").hash()


def test_hash_of_files_is_partial():
    a, b = b"a" * 5000, b"a" * 2500 + b"b" + b"a" * 2499
    assert formats.partial_hash(a) == formats.partial_hash(b) != formats.partial_hash(b"b" + a[1:])


def test_stream_ingest_is_repeatable(spark, tmp_path):
    from folioloom.streaming.ingest import ingest, markup_stream

    (tmp_path / "in").mkdir()
    span = '<div class="page"><p><span class="f1" data-bbox="1,2,3,4" data-line="1" data-segment="1">x</span></p></div>'
    (tmp_path / "in" / "a.html").write_text(span)
    for _ in range(2):
        ingest(markup_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_files_lead_to_nodes_with_their_paths_as_keys(spark, tmp_path):
    from folioloom.sources.files import markup_files

    rows = [element(d, i, f"Heading {d} number {i}" if i % 4 == 0 else f"body text {i}", HEAD if i % 4 == 0 else BODY, para=i, y=72.0 + 24 * i) for d in (1, 2) for i in range(8)]
    te = spark.createDataFrame(rows, TE)
    classes = spark.createDataFrame([(d, *s) for d in (1, 2) for s in (HEAD, BODY)], "doc_id bigint, class_name string, font_family string, font_size float, font_style string, font_weight string, color string")
    for r in markup.build(te, classes).collect():
        (tmp_path / f"{r.doc_id}.xhtml").write_text(r.xhtml)
    files = markup_files(spark, str(tmp_path))
    by_path = {r.doc_id.rsplit("/", 1)[1][0]: r.n for r in Pipeline(markup.text_elements(files), markup.font_classes(files)).nodes.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    by_number = {str(r.doc_id): r.n for r in Pipeline(te, classes).nodes.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert by_path == by_number and set(by_path) == {"1", "2"}


def test_metadata_is_merged_field_by_field(spark):
    inferred = spark.createDataFrame([(1, "A", "me", 3), (2, "B", None, 4), (3, "C", None, None)], "doc_id bigint, title string, author string, page_count int")
    given = spark.createDataFrame([(1, "", None, 0, "x"), (2, None, "you", 9, "y"), (2, None, "you", 9, "y")], "doc_id bigint, title string, author string, page_count int, other string")
    got = {r.doc_id: (r.title, r.author, r.page_count) for r in tree.merge_metadata(inferred, given).collect()}
    assert got == {1: ("", "me", 3), 2: ("B", "you", 9), 3: ("C", None, None)}

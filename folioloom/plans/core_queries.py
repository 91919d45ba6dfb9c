"""Queries of the document-structure operators and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.config import preset
from folioloom.functions.blocks import before
from folioloom.operators import clustering, elements, headings, navigate, profile, tree, typography, validate
from folioloom.plans import formats
from folioloom.plans.pipeline import Pipeline
from folioloom.session import checkpointed
from folioloom.sources import markup
from folioloom.sources.tables import table

CLI = preset("cli")
#: Words of the generic type's section patterns, for a query that has section patterns at all.
WORDS = ("summary", "appendix", "background")


def _te(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "text_elements")


def _fc(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "font_classes")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nodes").filter("id is not null").dropDuplicates(["doc_id", "id"])


def _flat(s: SparkSession, d: str) -> DataFrame:
    return profile.flat_nodes(table(s, d, "nodes"))


def _pipeline(s: SparkSession, d: str) -> Pipeline:
    return Pipeline(_te(s, d), _fc(s, d), table(s, d, "document_metadata"), preset("cli"))


def a4_most_common(s: SparkSession, d: str) -> DataFrame:
    return typography.document_analysis(_te(s, d)).select("doc_id", F.col("most_common_font_size").cast("double").alias("size"), F.col("most_common_font_family").alias("family"))


def a8_size_analysis(s: SparkSession, d: str) -> DataFrame:
    a = typography.font_size_analysis(_te(s, d), _fc(s, d))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("double").cast("decimal(18,2)").cast("string")), ",")
    return a.select(
        "doc_id", "median_size", "min_size", "max_size", "body_text_size", join("rare_large_sizes").alias("rare"), join("potential_header_sizes").alias("potential"), "size_usage_ratio",
        F.size("hierarchy_levels").alias("levels"),
    )


def r1_parsed(s: SparkSession, d: str) -> DataFrame:
    return elements.parsed(_te(s, d)).select("doc_id", "position", "element_type", "hierarchy_level", "reading_order", "text", "token_count")


def _marked(s: SparkSession, d: str) -> DataFrame:
    p = _pipeline(s, d)
    return headings.mark_headings(p.parsed, p.sizes, CLI.headings)


def r3_headings(s: SparkSession, d: str) -> DataFrame:
    return _marked(s, d).filter("is_heading").select("doc_id", "reading_order", "text")


def r6_heading_levels(s: SparkSession, d: str) -> DataFrame:
    """The contextual levels of all headings."""
    return headings.heading_levels(checkpointed(_marked(s, d)), CLI.headings)


def r7_section_levels(s: SparkSession, d: str) -> DataFrame:
    p = _pipeline(s, d)
    return headings.detect_sections(p.parsed, p.sizes, CLI.headings).groupBy("doc_id", "element_type", "hierarchy_level").agg(F.count("*").alias("n"))


def r4_word_headings(s: SparkSession, d: str) -> DataFrame:
    """Headings where the configuration has section words too: a word makes a heading of any size."""
    p = _pipeline(s, d)
    return headings.mark_headings(p.parsed, p.sizes, replace(CLI.headings, section_patterns=WORDS)).filter("is_heading").select("doc_id", "reading_order", "text")


def r13_ruled_elements(s: SparkSession, d: str) -> DataFrame:
    """The elements after all rules of the preset: sections at their levels, merged by paragraph and with their neighbours."""
    r = _pipeline(s, d).ruled
    return r.select("doc_id", "page_number", "reading_order", "element_type", "hierarchy_level", "text", "bounding_box.*")


def r10_paragraphs(s: SparkSession, d: str) -> DataFrame:
    m = clustering.merge_paragraphs(checkpointed(elements.parsed(_te(s, d))))
    return m.select("doc_id", "page_number", "paragraph_number", "reading_order", "text", "bounding_box.*", "token_count")


def r11_clusters(s: SparkSession, d: str) -> DataFrame:
    """Elements after both merging steps."""
    c = clustering.cluster(checkpointed(elements.parsed(_te(s, d))), CLI.clustering)
    return c.select("doc_id", "page_number", "reading_order", "text", "bounding_box.*", "token_count")


def _validated(s: SparkSession, d: str) -> DataFrame:
    return checkpointed(elements.parsed(_te(s, d)))


def g_pipeline_nodes(s: SparkSession, d: str) -> DataFrame:
    n = _pipeline(s, d).nodes
    return n.select("doc_id", "id", "node_type", "location.semantic.path", "location.semantic.depth", "text_order", F.col("content.text").alias("text"), "token_count", "parent")


def g5_places(s: SparkSession, d: str) -> DataFrame:
    """Parents and paths of the given nodes, rebuilt from their order, type and depth alone."""
    n = _nodes(s, d).filter("text_order is not null").select(
        "doc_id", F.col("node_type").alias("element_type"), F.col("content.text").alias("text"), F.col("location.semantic.depth").alias("hierarchy_level"),
        F.lit(0).alias("page_number"), F.col("text_order").alias("reading_order"),
    )
    return tree.placed(checkpointed(n)).select("doc_id", "text_order", "parent_order", "path")


def g7_children(s: SparkSession, d: str) -> DataFrame:
    """Numbered children from parents, by blocks."""
    n = _nodes(s, d).filter("parent is not null and text_order is not null").select("doc_id", "parent", F.col("id").alias("child"), "text_order")
    return before(n, ["doc_id", "parent"], "text_order", F.lit(1), "place").select("doc_id", "parent", "child", "place")


def p1_subtree_profile(s: SparkSession, d: str) -> DataFrame:
    """Totals of every section's subtree."""
    flat = checkpointed(_flat(s, d))
    sub = profile.subtree_nodes(flat, navigate.of_type(flat, "Section"))
    return sub.groupBy("doc_id", "top").agg(F.count("*").alias("total_nodes"), F.sum("token_count").alias("total_tokens"), F.max("depth").alias("max_depth"))


def q7_render(s: SparkSession, d: str) -> DataFrame:
    nodes, flat = _nodes(s, d), checkpointed(_flat(s, d))
    return navigate.render(nodes, flat, navigate.roots(flat), node_types=True)


def _markup(s: SparkSession, d: str) -> DataFrame:
    e = elements.elements(_te(s, d)).filter("bounding_box is not null and text is not null")
    titles = table(s, d, "document_metadata").groupBy("doc_id").agg(F.max("title").alias("title")).filter("title is not null")
    return checkpointed(markup.build(e, _fc(s, d).distinct(), titles))


def x3_spans(s: SparkSession, d: str) -> DataFrame:
    return markup.spans(_markup(s, d)).select("doc_id", "page_number", "class_name", "text", "bounding_box.*", "line_number", "segment_number")


def x9_font_classes(s: SparkSession, d: str) -> DataFrame:
    return markup.font_classes(_markup(s, d))


def x8_metadata(s: SparkSession, d: str) -> DataFrame:
    return markup.metadata(_markup(s, d)).select("doc_id", "title")


def x11_elements(s: SparkSession, d: str) -> DataFrame:
    """Markup of all documents parsed again: page, fonts and tokens of each element."""
    e = markup.text_elements(_markup(s, d))
    return e.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.max("page_number").alias("pages"), F.max("reading_order").alias("last"))


def o1_graph_json(s: SparkSession, d: str) -> DataFrame:
    """Graphs with the metadata, its titles merged with the inferred ones, the font analysis and the structural profile."""
    n, m = _nodes(s, d), table(s, d, "document_metadata")
    # repeated rows don't change a title, so their texts needn't move
    rows = table(s, d, "nodes").filter("id is not null").select("doc_id", F.col("node_type").alias("element_type"), F.col("content.text").alias("text"), F.lit(0).alias("page_number"), F.col("text_order").alias("reading_order"))
    return formats.graph(n, formats.metadata(m, tree.merge_titles(rows, m)), typography.document_analysis(_te(s, d)))


def o2_sequential(s: SparkSession, d: str) -> DataFrame:
    """The segments' columns that its SQL names; o2_sequential_documents has them whole."""
    path, page = F.col("location.semantic.path").alias("path"), F.col("location.physical.page").alias("page")
    return formats.sequential(_nodes(s, d)).select("doc_id", "segment", "node_type", "text", path, page, "tokens")


QUERIES = {
    "a1_font_size_counts": lambda s, d: typography.size_counts(_te(s, d)),
    "a2_font_family_counts": lambda s, d: typography.family_counts(_te(s, d)),
    "a3_weight_counts": lambda s, d: typography.weight_counts(_te(s, d)),
    "a4_most_common": a4_most_common,
    "a5_size_runs": lambda s, d: typography.size_runs(_te(s, d)).select("doc_id", F.inline("all_font_sizes")),
    "a6_class_counts": lambda s, d: typography.class_counts(_te(s, d)),
    "a7_known_sizes": lambda s, d: typography.known_sizes(_te(s, d), _fc(s, d)),
    "a8_size_analysis": a8_size_analysis,
    "r1_parsed": r1_parsed,
    "r3_headings": r3_headings,
    "r4_word_headings": r4_word_headings,
    "r6_heading_levels": r6_heading_levels,
    "r13_ruled_elements": r13_ruled_elements,
    "r7_section_levels": r7_section_levels,
    "r10_paragraphs": r10_paragraphs,
    "r11_clusters": r11_clusters,
    "r15_issues": lambda s, d: validate.issues(_validated(s, d), CLI.headings.max_depth).drop("detail"),
    "r21_quality": lambda s, d: validate.quality(_validated(s, d), CLI.headings.max_depth),
    "r15_ruled_issues": lambda s, d: _pipeline(s, d).issues.drop("detail"),
    "r21_ruled_quality": lambda s, d: _pipeline(s, d).quality,
    "g5_places": g5_places,
    "g7_children": g7_children,
    "g12_subtrees": lambda s, d: tree.subtree_ranges(_nodes(s, d)),
    "g_pipeline_nodes": g_pipeline_nodes,
    "profile_subtrees": p1_subtree_profile,
    "profile_histograms": lambda s, d: profile.histograms(checkpointed(_flat(s, d))),
    "profile_tokens": lambda s, d: profile.token_statistics(checkpointed(_flat(s, d))),
    "profile_types": lambda s, d: profile.type_distribution(_flat(s, d)),
    "profile_depths": lambda s, d: profile.depth_distribution(_flat(s, d)),
    "profile_totals": lambda s, d: profile.profile(checkpointed(_flat(s, d))).select("doc_id", "total_nodes", "total_tokens", "max_depth", "avg_depth", "document_type", "flow_type"),
    "o1_graph_json": o1_graph_json,
    "o2_sequential": o2_sequential,
    "o2_sequential_documents": lambda s, d: formats.sequential_documents(_nodes(s, d)),
    "o3_flat": lambda s, d: formats.flat(_nodes(s, d)).select("doc_id", F.posexplode("chunks").alias("place", "chunk")),
    "o9_text_hashes": lambda s, d: table(s, d, "documents").select("doc_id", formats.text_hash(F.col("text")).alias("hash")),
    "q1_sections": lambda s, d: navigate.of_type(_nodes(s, d), "Section").select("doc_id", "id", F.col("content.text").alias("text")),
    "q2_roots": lambda s, d: navigate.roots(_nodes(s, d)).select("doc_id", "id"),
    "q4_page_one": lambda s, d: navigate.on_page(_nodes(s, d), 1).select("doc_id", "id"),
    "q5_parents": lambda s, d: navigate.parents(_nodes(s, d)),
    "q6_children": lambda s, d: navigate.children(_nodes(s, d)),
    "q7_render": q7_render,
    "x3_spans": x3_spans,
    "x8_metadata": x8_metadata,
    "x9_font_classes": x9_font_classes,
    "x11_elements": x11_elements,
}

_E = "(SELECT DISTINCT * FROM text_elements WHERE doc_id IS NOT NULL AND reading_order IS NOT NULL)"
_N = "(SELECT DISTINCT * FROM nodes WHERE id IS NOT NULL)"
_STYLED = f"(SELECT doc_id, reading_order, style_info.* FROM {_E} WHERE style_info.font_size IS NOT NULL)"
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}\x{{0b}}]+|[\s\p{{Z}}\x{{85}}\x{{0b}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c)


_PARSED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) - 1 AS position FROM {_E}) WHERE {_trim('text')} <> '')"
_ONE = "format('{:.1f}', round_even(CAST(font_size AS DOUBLE), 1))"
_KNOWN = f"""(SELECT c.doc_id, round(CAST(f.size AS DOUBLE), 2) AS size, CAST(sum(c.n) AS BIGINT) AS n
  FROM (SELECT doc_id, class_name, count(*) AS n FROM {_STYLED} GROUP BY ALL) c
  JOIN (SELECT doc_id, class_name, max(font_size) AS size FROM font_classes WHERE class_name IS NOT NULL GROUP BY ALL) f USING (doc_id, class_name) GROUP BY 1, 2)"""
_SIZES = f"""
k AS {_KNOWN},
t AS (SELECT doc_id, sum(n) AS total, max(n) AS max_n, min(size) AS min_size, max(size) AS max_size, arg_max(size, n * 100000 - size) AS body FROM k GROUP BY doc_id),
m AS (SELECT k.doc_id, min(size) AS median FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY size) AS upto FROM k) k JOIN t USING (doc_id) WHERE upto > total // 2 GROUP BY 1),
c AS (SELECT doc_id, CAST(arg_max(s, n * 100000 - s) AS FLOAT) AS common FROM (SELECT doc_id, CAST({_ONE} AS DOUBLE) AS s, count(*) AS n FROM {_STYLED} GROUP BY ALL) GROUP BY 1)"""
_HEADINGS = f"""
WITH {_SIZES},
p AS {_PARSED},
j AS (SELECT p.*, style_info.font_size AS fs, lower(coalesce(style_info.font_weight, '')) LIKE '%bold%' AS bold, CAST(coalesce(t.body, 12) AS FLOAT) AS body, strlen({_trim('text')}) AS bytes,
        EXISTS (SELECT 1 FROM k WHERE k.doc_id = p.doc_id AND k.size > t.body AND k.n < t.max_n // 2 AND CAST(k.size AS FLOAT) = style_info.font_size) AS potential
      FROM p LEFT JOIN t USING (doc_id)),
h AS (SELECT * FROM j WHERE fs >= CAST(9.5 AS FLOAT) AND (fs > body OR potential OR bold) AND bytes >= 3 AND (bytes >= 8 OR bold OR potential))"""
_LEVELS = _HEADINGS.replace("\nWITH ", "\nWITH RECURSIVE ") + """,
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) - 1 AS heading, CAST(fs AS DOUBLE) AS size FROM h),
f AS (
  SELECT doc_id, heading, size, 1 AS level, [size] AS fonts FROM n WHERE heading = 0
  UNION ALL
  SELECT doc_id, heading, size, new, list_concat(list_concat(padded[1:new-1], [size]), padded[new+1:]) FROM (
    SELECT *, list_concat(fonts, list_transform(range(greatest(new - len(fonts), 0)), lambda x: CAST(0 AS DOUBLE))) AS padded FROM (
      SELECT n.doc_id, n.heading, n.size, f.fonts,
        CASE WHEN n.size < f.size THEN CASE WHEN f.level + 1 > 6 THEN f.level ELSE f.level + 1 END
             WHEN abs(n.size - f.size) < 0.1 THEN f.level
             ELSE CAST(coalesce(nullif(list_position(list_transform(f.fonts, lambda x: abs(x - n.size) < 0.1), true), 0),
                           nullif(list_position(list_transform(f.fonts, lambda x: x < n.size), true), 0), 1) AS INTEGER) END AS new
      FROM f JOIN n ON n.doc_id = f.doc_id AND n.heading = f.heading + 1)))
"""
_C = CLI.clustering
_WHOLE = "coalesce(NOT isnan({0}.x + {0}.y + {0}.width + {0}.height), false)"
#: Sections and paragraphs as r7, merged by paragraph as r10, then with their neighbours on the page by a recursion.
_RULED = _LEVELS + f""",
o AS (SELECT p.*, h.reading_order IS NOT NULL AS is_h, count(h.reading_order) OVER (PARTITION BY p.doc_id ORDER BY p.reading_order) - 1 AS heading
      FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.reading_order = p.reading_order),
s AS (SELECT o.doc_id, page_number, paragraph_number, reading_order, text, bounding_box, token_count, CASE WHEN is_h THEN 'Section' ELSE 'Paragraph' END AS element_type,
        CAST(CASE WHEN is_h THEN level ELSE coalesce(level, 1) + 1 END AS INTEGER) AS hierarchy_level
      FROM o LEFT JOIN f ON f.doc_id = o.doc_id AND f.heading = o.heading),
m1 AS (SELECT doc_id, page_number, min(reading_order) AS reading_order, arg_min(element_type, reading_order) AS element_type, arg_min(hierarchy_level, reading_order) AS hierarchy_level,
         string_agg(text, ' ' ORDER BY reading_order) AS text, sum(token_count) AS tokens, min(bounding_box.x) AS x, min(bounding_box.y) AS y,
         max(bounding_box.x + bounding_box.width) - min(bounding_box.x) AS width, max(bounding_box.y + bounding_box.height) - min(bounding_box.y) AS height
       FROM s GROUP BY doc_id, page_number, paragraph_number),
q AS (SELECT *, strlen(text) AS bytes, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY reading_order) AS place FROM m1),
u AS (
  SELECT doc_id, page_number, place, reading_order AS head, element_type, hierarchy_level, bytes, x, y, width, height FROM q WHERE place = 1
  UNION ALL
  SELECT doc_id, page_number, place, CASE WHEN joins THEN head ELSE reading_order END, element_type, hierarchy_level, CASE WHEN joins THEN head_bytes ELSE 0 END + bytes,
    CASE WHEN joins THEN x0 ELSE x END, CASE WHEN joins THEN y0 ELSE y END, CASE WHEN joins THEN x1 - x0 ELSE width END, CASE WHEN joins THEN y1 - y0 ELSE height END FROM (
    SELECT q.*, u.head, u.bytes + 1 AS head_bytes, least(u.x, q.x) AS x0, least(u.y, q.y) AS y0, greatest(u.x + u.width, q.x + q.width) AS x1, greatest(u.y + u.height, q.y + q.height) AS y1,
      coalesce(u.element_type = q.element_type AND u.hierarchy_level = q.hierarchy_level AND {_WHOLE.format("u")} AND {_WHOLE.format("q")}
        AND u.bytes + q.bytes + 1 <= CASE WHEN q.element_type = 'Section' THEN {_C.max_section_size} ELSE {_C.max_paragraph_size} END
        AND greatest(q.y - (u.y + u.height), u.y - (q.y + q.height)) <= CAST({_C.min_line_height * _C.line_height_multiplier} AS FLOAT)
        AND greatest(u.x + u.width, q.x + q.width) - least(u.x, q.x) < u.width + q.width + CAST({_C.horizontal_tolerance} AS FLOAT), false) AS joins
    FROM u JOIN q ON q.doc_id = u.doc_id AND q.page_number = u.page_number AND q.place = u.place + 1)),
r AS (SELECT u.doc_id, u.page_number, head AS reading_order, any_value(u.element_type) AS element_type, any_value(u.hierarchy_level) AS hierarchy_level,
        string_agg(q.text, ' ' ORDER BY q.place) AS text, CAST(sum(q.tokens) AS BIGINT) AS tokens, arg_max(struct_pack(x := u.x, y := u.y, w := u.width, h := u.height), u.place) AS b
      FROM u JOIN q USING (doc_id, page_number, place) GROUP BY u.doc_id, u.page_number, head),
w AS (SELECT *, strlen({_trim('text')}) AS bytes, lag(hierarchy_level) OVER o AS pl, coalesce(lag(reading_order) OVER o + 1, 0) AS expected, lag(page_number) OVER o AS pp
      FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY page_number, reading_order)),
i AS (
  SELECT doc_id, 'orphaned_element' AS issue, reading_order FROM w WHERE hierarchy_level > {CLI.headings.max_depth}
  UNION ALL SELECT doc_id, 'hierarchy_jump', reading_order FROM w WHERE hierarchy_level > pl + 1
  UNION ALL SELECT doc_id, 'reading_order', reading_order FROM w WHERE reading_order < greatest(expected - 5, 0) OR reading_order > expected + 10
  UNION ALL SELECT doc_id, 'invalid_box', reading_order FROM w WHERE b.x < 0 OR b.y < 0 OR b.w <= 0 OR b.h <= 0
  UNION ALL SELECT doc_id, 'page_zero', reading_order FROM w WHERE page_number = 0
  UNION ALL SELECT doc_id, 'page_jump', reading_order FROM w WHERE page_number > pp + 5
  UNION ALL SELECT doc_id, 'short_section', reading_order FROM w WHERE element_type = 'Section' AND bytes < 3
  UNION ALL SELECT doc_id, 'long_section', reading_order FROM w WHERE element_type = 'Section' AND bytes > 200)
"""
#: The same merging over untyped elements.
_MERGED = f"""
WITH RECURSIVE s AS (SELECT doc_id, page_number, paragraph_number, reading_order, text, bounding_box, token_count, 'Paragraph' AS element_type, 1 AS hierarchy_level FROM {_PARSED})""" + _RULED[_RULED.index(",\nm1 AS") : _RULED.index(",\nw AS")]
#: The tree over the ruled elements by a recursion in reading order; the stack of open sections is carried along.
_PLACED = _RULED + """,
d AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order) - 1 AS INTEGER) AS o, element_type, hierarchy_level AS l, text, tokens FROM r),
z AS (
  SELECT doc_id, -1 AS o, [struct_pack(o := -1, l := 0, path := '', n := 0)] AS stack, -1 AS parent, '' AS path FROM (SELECT DISTINCT doc_id FROM d)
  UNION ALL
  SELECT doc_id, o, CASE WHEN element_type = 'Section'
      THEN list_concat(open[1:coalesce(list_max(list_filter(range(1, len(open) + 1), lambda i: open[i].l < l)), 1)], [struct_pack(o := o, l := l, path := path, n := 0)]) ELSE open END, parent, path FROM (
    SELECT *, list_concat(cut[1:len(cut) - 1], [struct_pack(o := top.o, l := top.l, path := top.path, n := top.n + 1)]) AS open, top.o AS parent,
      CASE WHEN top.path = '' THEN '' ELSE top.path || '.' END || CAST(top.n + 1 AS VARCHAR) AS path FROM (
      SELECT *, cut[len(cut)] AS top FROM (
        SELECT d.*, CASE WHEN d.l <= 1 THEN z.stack[1:1] ELSE z.stack[1:d.l] END AS cut FROM z JOIN d ON d.doc_id = z.doc_id AND d.o = z.o + 1))))
"""
_FLAT = "(SELECT DISTINCT doc_id, id, node_type, location.semantic.depth AS depth, coalesce(token_count, 0) AS v, location.semantic.path AS path FROM nodes WHERE id IS NOT NULL)"
_SETS = f"(SELECT doc_id, true AS overall, NULL AS node_type, v FROM {_FLAT} UNION ALL SELECT doc_id, false, node_type, v FROM {_FLAT})"
_HIST = f"""
s AS {_SETS},
r AS (SELECT doc_id, overall, node_type, min(v) AS low, max(v) AS high, greatest(CAST(ceil((max(v) - min(v)) / 10.0) AS BIGINT), 1) AS w FROM s GROUP BY ALL),
b AS (SELECT *, unnest(range(greatest(CAST(ceil((high - low) / CAST(w AS DOUBLE)) AS BIGINT), 1))) AS bin FROM r),
hist AS (SELECT b.doc_id, b.overall, b.node_type, CAST(b.bin AS INTEGER) AS bin, low + bin * w AS range_start, least(low + (bin + 1) * w, high + 1) AS range_end,
       count(s.v) AS count, CAST(coalesce(sum(s.v), 0) AS BIGINT) AS token_sum
  FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND s.overall = b.overall AND s.node_type IS NOT DISTINCT FROM b.node_type AND s.v >= low + bin * w AND s.v < least(low + (bin + 1) * w, high + 1)
    AND (low = high OR s.v < low + CAST(ceil((high - low) / CAST(w AS DOUBLE)) AS BIGINT) * w)
  GROUP BY ALL)"""
_PREFIX = f"""
f AS {_FLAT},
a AS (SELECT f.*, '' AS prefix FROM f UNION ALL
      SELECT f.doc_id, f.id, f.node_type, f.depth, f.v, f.path, array_to_string(string_split(path, '.')[1:k], '.') FROM (SELECT *, unnest(range(1, len(string_split(path, '.')) + 1)) AS k FROM f WHERE path <> '') f)"""

SQL = {
    "a1_font_size_counts": f"SELECT doc_id, {_ONE} AS font_size, count(*) AS n FROM {_STYLED} GROUP BY ALL",
    "a2_font_family_counts": f"SELECT doc_id, font_family, count(*) AS n FROM {_STYLED} GROUP BY ALL",
    "a3_weight_counts": f"""SELECT doc_id, CAST(sum(b) AS BIGINT) AS bold, CAST(sum(1 - b) AS BIGINT) AS not_bold, CAST(sum(i) AS BIGINT) AS italic, CAST(sum(1 - i) AS BIGINT) AS not_italic FROM (
SELECT doc_id, CAST(coalesce(lower(font_weight) LIKE '%bold%', false) AS BIGINT) AS b, CAST(coalesce(lower(font_style) LIKE '%italic%', false) AS BIGINT) AS i FROM {_STYLED}) GROUP BY 1""",
    "a4_most_common": f"""WITH {_SIZES}, g AS (SELECT doc_id, font_family, count(*) AS n FROM {_STYLED} GROUP BY ALL)
SELECT c.doc_id, CAST(common AS DOUBLE) AS size, (SELECT font_family FROM g WHERE g.doc_id = c.doc_id ORDER BY n DESC, font_family LIMIT 1) AS family FROM c""",
    "a5_size_runs": f"SELECT doc_id, font_size, count(*) AS n FROM {_STYLED} GROUP BY ALL",
    "a6_class_counts": f"SELECT doc_id, class_name, count(*) AS n FROM {_STYLED} GROUP BY ALL",
    "a7_known_sizes": f"SELECT * FROM {_KNOWN}",
    "a8_size_analysis": f"""WITH {_SIZES}
SELECT t.doc_id, median AS median_size, min_size, max_size, body AS body_text_size,
  coalesce((SELECT string_agg(CAST(CAST(size AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY size DESC) FROM k WHERE k.doc_id = t.doc_id AND size > median AND n <= greatest(floor(total * 0.1), 1)), '') AS rare,
  coalesce((SELECT string_agg(CAST(CAST(size AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY size DESC) FROM k WHERE k.doc_id = t.doc_id AND size > body AND n < max_n // 2), '') AS potential,
  CAST(max_n AS DOUBLE) / total AS size_usage_ratio, CAST((SELECT count(*) FROM k WHERE k.doc_id = t.doc_id) AS INTEGER) AS levels
FROM t JOIN m USING (doc_id)""",
    "r1_parsed": f"SELECT doc_id, position, 'Paragraph' AS element_type, 1 AS hierarchy_level, reading_order, text, token_count FROM {_PARSED}",
    "r3_headings": _HEADINGS + "SELECT doc_id, reading_order, text FROM h",
    "r4_word_headings": _HEADINGS.split("\nh AS (")[0] + f"""
h AS (SELECT * FROM j WHERE (fs >= CAST(9.5 AS FLOAT) AND (fs > body OR potential OR bold) OR {' OR '.join(f"contains(lower(text), '{w}')" for w in WORDS)}) AND bytes >= 3 AND (bytes >= 8 OR bold OR potential))
SELECT doc_id, reading_order, text FROM h""",
    "r11_clusters": _MERGED + "\nSELECT doc_id, page_number, reading_order, text, b.x AS x, b.y AS y, b.w AS width, b.h AS height, tokens AS token_count FROM r",
    "r13_ruled_elements": _RULED + "SELECT doc_id, page_number, reading_order, element_type, hierarchy_level, text, b.x AS x, b.y AS y, b.w AS width, b.h AS height FROM r",
    "g_pipeline_nodes": _PLACED + f"""
SELECT d.doc_id, sha256(d.doc_id || ':' || d.o) AS id, element_type AS node_type, z.path, l AS depth, d.o AS text_order, {_trim('text')} AS text, tokens AS token_count,
  CASE WHEN parent < 0 THEN sha256(d.doc_id || ':root') ELSE sha256(d.doc_id || ':' || parent) END AS parent
FROM d JOIN z ON z.doc_id = d.doc_id AND z.o = d.o
UNION ALL SELECT DISTINCT doc_id, sha256(doc_id || ':root'), 'Document', '', 0, NULL, 'Document', 0, NULL FROM d""",
    "r6_heading_levels": _LEVELS + "SELECT doc_id, heading, level FROM f",
    "r7_section_levels": _LEVELS + """,
o AS (SELECT p.doc_id, p.reading_order, h.reading_order IS NOT NULL AS is_h,
        count(h.reading_order) OVER (PARTITION BY p.doc_id ORDER BY p.reading_order) - 1 AS heading
      FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.reading_order = p.reading_order)
SELECT o.doc_id, CASE WHEN is_h THEN 'Section' ELSE 'Paragraph' END AS element_type, CAST(CASE WHEN is_h THEN level ELSE coalesce(level, 1) + 1 END AS INTEGER) AS hierarchy_level, count(*) AS n
FROM o LEFT JOIN f ON f.doc_id = o.doc_id AND f.heading = o.heading GROUP BY ALL""",
    "r10_paragraphs": f"""SELECT doc_id, page_number, paragraph_number, min(reading_order) AS reading_order, string_agg(text, ' ' ORDER BY reading_order) AS text,
  min(bounding_box.x) AS x, min(bounding_box.y) AS y, max(bounding_box.x + bounding_box.width) - min(bounding_box.x) AS width,
  max(bounding_box.y + bounding_box.height) - min(bounding_box.y) AS height, CAST(sum(token_count) AS BIGINT) AS token_count FROM {_PARSED} GROUP BY 1, 2, 3""",
    "r15_issues": f"""WITH p AS (SELECT *, bounding_box.x AS x, bounding_box.y AS y, bounding_box.width AS w, bounding_box.height AS h,
  lag(reading_order) OVER o AS pr, lag(page_number) OVER o AS pp FROM {_PARSED} WINDOW o AS (PARTITION BY doc_id ORDER BY reading_order))
SELECT doc_id, 'reading_order' AS issue, reading_order FROM p WHERE reading_order < greatest(coalesce(pr + 1, 0) - 5, 0) OR reading_order > coalesce(pr + 1, 0) + 10
UNION ALL SELECT doc_id, 'invalid_box', reading_order FROM p WHERE x < 0 OR y < 0 OR w <= 0 OR h <= 0
UNION ALL SELECT doc_id, 'page_zero', reading_order FROM p WHERE page_number = 0
UNION ALL SELECT doc_id, 'page_jump', reading_order FROM p WHERE page_number > pp + 5""",
    "r21_quality": f"""WITH i AS (@ISSUES@), e AS (SELECT doc_id, count(*) AS elements FROM {_PARSED} GROUP BY 1),
b AS (SELECT doc_id, count(*) AS issues FROM i GROUP BY 1)
SELECT e.doc_id, elements, coalesce(issues, 0) AS issues, greatest(0.0::DOUBLE, 1 - coalesce(issues, 0) / CAST(elements AS DOUBLE)) AS score FROM e LEFT JOIN b ON b.doc_id = e.doc_id""",
    "r15_ruled_issues": _RULED + "SELECT * FROM i",
    "r21_ruled_quality": _RULED + """, e AS (SELECT doc_id, count(*) AS elements FROM r GROUP BY 1), b AS (SELECT doc_id, count(*) AS issues FROM i GROUP BY 1)
SELECT e.doc_id, elements, coalesce(issues, 0) AS issues, greatest(0.0::DOUBLE, 1 - coalesce(issues, 0) / CAST(elements AS DOUBLE)) AS score FROM e LEFT JOIN b ON b.doc_id = e.doc_id""",
    "g5_places": f"""WITH n AS (SELECT * FROM {_N} WHERE text_order IS NOT NULL)
SELECT c.doc_id, c.text_order, coalesce(p.text_order, -1) AS parent_order, c.location.semantic.path AS path FROM n c LEFT JOIN n p ON p.doc_id = c.doc_id AND p.id = c.parent""",
    "g7_children": f"""SELECT doc_id, parent, id AS child, row_number() OVER (PARTITION BY doc_id, parent ORDER BY text_order) - 1 AS place
FROM {_N} WHERE parent IS NOT NULL AND text_order IS NOT NULL""",
    "g12_subtrees": f"""WITH n AS (SELECT doc_id, id, text_order, location.semantic.path AS path FROM {_N})
SELECT t.doc_id, t.id, min(s.text_order) AS first, max(s.text_order) AS last FROM n t JOIN n s ON s.doc_id = t.doc_id AND (t.path = '' OR s.path = t.path OR s.path LIKE t.path || '.%') GROUP BY ALL""",
    "profile_subtrees": f"""WITH {_PREFIX} SELECT t.doc_id, t.id AS top, count(*) AS total_nodes, CAST(sum(a.v) AS BIGINT) AS total_tokens, max(a.depth) AS max_depth
FROM f t JOIN a ON a.doc_id = t.doc_id AND a.prefix = t.path WHERE t.node_type = 'Section' GROUP BY ALL""",
    "profile_histograms": f"WITH {_HIST} SELECT * FROM hist",
    "profile_tokens": f"""WITH {_HIST}
SELECT s.doc_id, s.overall, s.node_type, count(*) AS total_count, CAST(sum(v) AS BIGINT) AS total_tokens, avg(v) AS mean, median(v) AS median, coalesce(var_samp(v), 0) AS variance,
  (SELECT range_start FROM hist h WHERE h.doc_id = s.doc_id AND h.overall = s.overall AND h.node_type IS NOT DISTINCT FROM s.node_type ORDER BY count DESC, range_start DESC LIMIT 1) AS mode
FROM s GROUP BY s.doc_id, s.overall, s.node_type""",
    "profile_types": f"SELECT doc_id, node_type, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE) AS percentage FROM {_FLAT} GROUP BY doc_id, node_type",
    "profile_depths": f"SELECT doc_id, depth, count(*) AS n FROM {_FLAT} GROUP BY ALL",
    "profile_totals": f"SELECT doc_id, count(*) AS total_nodes, CAST(sum(v) AS BIGINT) AS total_tokens, coalesce(max(depth), 0) AS max_depth, avg(depth) AS avg_depth, 'Generic' AS document_type, 'Fixed' AS flow_type FROM {_FLAT} GROUP BY 1",
    "o2_sequential": f"SELECT doc_id, coalesce(text_order + 1, 0) AS segment, node_type, content.text AS text, location.semantic.path AS path, location.physical.page AS page, token_count AS tokens FROM {_N}",
    "o3_flat": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(text_order, -1), id) - 1 AS INTEGER) AS place, content.text AS chunk FROM {_N}",
    "o9_text_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "q1_sections": f"SELECT doc_id, id, content.text AS text FROM {_N} WHERE node_type = 'Section'",
    "q2_roots": f"SELECT doc_id, id FROM {_N} WHERE parent IS NULL",
    "q4_page_one": f"SELECT doc_id, id FROM {_N} WHERE location.physical.page = 1",
    "q5_parents": f"SELECT c.doc_id, c.id, p.id AS parent_id, p.node_type AS parent_type FROM {_N} c LEFT JOIN {_N} p ON p.doc_id = c.doc_id AND p.id = c.parent",
    "q6_children": f"""SELECT c.doc_id, c.id, CAST(c.i - 1 AS INTEGER) AS position, c.kids[c.i] AS child_id FROM (SELECT doc_id, id, children AS kids, unnest(range(1, len(children) + 1)) AS i FROM {_N}) c
WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = c.doc_id AND n.id = c.kids[c.i])""",
    "q7_render": f"""SELECT r.doc_id, r.id AS top, string_agg('[' || n.node_type || '] ' || coalesce(n.content.text, ''), chr(10) || chr(10) ORDER BY coalesce(n.text_order, -1)) AS text
FROM {_N} r JOIN {_N} n ON n.doc_id = r.doc_id WHERE r.parent IS NULL GROUP BY ALL""",
    "x3_spans": f"""SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number) AS INTEGER) AS page_number, style_info.class_name AS class_name, {_trim("replace(text, '<', '')")} AS text,
  bounding_box.x AS x, bounding_box.y AS y, bounding_box.width AS width, bounding_box.height AS height, line_number, segment_number
FROM {_E} WHERE {_trim("replace(text, '<', '')")} <> '' AND bounding_box.x IS NOT NULL AND bounding_box.y IS NOT NULL AND bounding_box.width IS NOT NULL AND bounding_box.height IS NOT NULL""",
}
SQL["r21_quality"] = SQL["r21_quality"].replace("@ISSUES@", SQL["r15_issues"])
_WITH_MARKUP = f"(SELECT DISTINCT doc_id FROM {_E} WHERE bounding_box IS NOT NULL AND text IS NOT NULL)"
SQL["x8_metadata"] = f"""SELECT e.doc_id, replace(m.title, chr(34), chr(39)) AS title FROM {_WITH_MARKUP} e
LEFT JOIN (SELECT doc_id, max(title) AS title FROM document_metadata GROUP BY 1) m USING (doc_id)"""
SQL["x9_font_classes"] = f"SELECT DISTINCT f.* FROM font_classes f JOIN {_WITH_MARKUP} e USING (doc_id) WHERE class_name IS NOT NULL"
SQL["x11_elements"] = f"""WITH s AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number) AS page, {_trim("replace(text, '<', '')")} AS t FROM {_E}
  WHERE bounding_box.x IS NOT NULL AND bounding_box.y IS NOT NULL AND bounding_box.width IS NOT NULL AND bounding_box.height IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, count(*) AS n, CAST(sum(strlen(t) // 4) AS BIGINT) AS tokens, CAST(max(page) AS INTEGER) AS pages, CAST(count(*) - 1 AS INTEGER) AS last FROM s WHERE t <> '' GROUP BY 1"""

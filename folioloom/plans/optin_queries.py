"""Queries of the opt-in rules (patterns, lists, sizes), the cache and minimal parsing, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.config import BULLETS, NUMBERED, Lists, Sizing
from folioloom.operators import inspect, lists, sizing, tree
from folioloom.operators.elements import elements, parsed
from folioloom.plans import formats
from folioloom.plans.core_queries import _E, _N, _PARSED, CLI, _markup, _nodes, _trim
from folioloom.sources import markup
from folioloom.session import checkpointed
from folioloom.sources.tables import table

#: Patterns of headings.
PATTERNS = (r"^[A-Z][A-Z\s]{2,}$", r"^\d+\.\s+[A-Z][a-z]{3,}", r"^(Chapter|Section|Part|Article)\s+\d+", r"^[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*:$")
MIN_SIZE = 9.5
LISTS, SIZES = Lists(), Sizing(max_size=80)
#: Which documents the cache of ``o7_uncached`` holds.
IN_TIME = "ingested_at <= authored_at + INTERVAL 1 DAY"


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return checkpointed(parsed(table(s, d, "text_elements")))


def r23_pattern_sections(s: SparkSession, d: str) -> DataFrame:
    out = lists.patterns_to_sections(_parsed(s, d), PATTERNS, MIN_SIZE, True)
    return out.filter("element_type = 'Section'").select("doc_id", "reading_order", "text")


def r30_lists(s: SparkSession, d: str) -> DataFrame:
    """Elements after list detection."""
    return lists.detect_lists(_parsed(s, d), LISTS).select("doc_id", "reading_order", "element_type", "text", "token_count")


def r33_oversized(s: SparkSession, d: str) -> DataFrame:
    p = parsed(table(s, d, "text_elements"))
    return p.select("doc_id", "reading_order", *[sizing.measure(F.col("text"), u).cast("bigint").alias(u) for u in ("characters", "words", "bytes")]).filter(F.col("characters") > SIZES.max_size)


def o7_uncached(s: SparkSession, d: str) -> DataFrame:
    """Documents whose content, under this configuration and version, isn't among those stored in time (within a day of writing)."""
    docs = table(s, d, "documents").filter("text is not null").withColumn("cache_hash", formats.cache_key(formats.text_hash(F.col("text")), CLI.hash()))
    return formats.uncached(docs, docs.filter(IN_TIME)).select("doc_id")


def x4_style_lookup(s: SparkSession, d: str) -> DataFrame:
    """Every element's font looked up by class; missing classes fall back."""
    e = elements(table(s, d, "text_elements")).select("doc_id", "reading_order", F.col("style_info.class_name").alias("class_name"))
    f = table(s, d, "font_classes").groupBy("doc_id", "class_name").agg(F.max(F.struct("font_family", "font_size")).alias("f"))
    return e.join(f, ["doc_id", "class_name"], "left").select(
        "doc_id", "reading_order", "class_name", F.coalesce("f.font_family", F.lit("unknown")).alias("font_family"), F.coalesce("f.font_size", F.lit(12.0)).cast("double").alias("font_size")
    )


def a16_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles inferred from the first sections, overwritten by the metadata's."""
    n = _nodes(s, d).filter("text_order is not null").select(
        "doc_id", F.col("node_type").alias("element_type"), F.col("content.text").alias("text"), F.lit(0).alias("page_number"), F.col("text_order").alias("reading_order")
    )
    return tree.merge_titles(n, table(s, d, "document_metadata"))


QUERIES = {
    "a14_classes": lambda s, d: inspect.classify(table(s, d, "text_elements")),
    "a16_titles": a16_titles,
    "r22_matching": lambda s, d: inspect.matching(table(s, d, "text_elements"), [r"^Page \d+", "(2"]),
    "x1_pages": lambda s, d: markup.pages(_markup(s, d)).groupBy("doc_id").agg(F.count("*").alias("pages")),
    "x2_paragraphs": lambda s, d: markup.paragraphs(_markup(s, d)).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), (F.max("paragraph_number") + 1).cast("bigint").alias("last")),
    "r23_pattern_sections": r23_pattern_sections,
    "r24_markers": lambda s, d: lists.markers(_parsed(s, d), LISTS).select("doc_id", "index", "bullet", "numbered"),
    "r25_sequences": lambda s, d: lists.sequences(_parsed(s, d), LISTS),
    "r26_items": lambda s, d: lists.items(_parsed(s, d), LISTS).select("doc_id", "list_no", "item_no", "text", "first", "last"),
    "r30_lists": r30_lists,
    "r33_oversized": r33_oversized,
    "r34_sized": lambda s, d: sizing.enforce(_parsed(s, d), SIZES).select("doc_id", "reading_order", "part", "text", "token_count"),
    "o7_uncached": o7_uncached,
    "x4_style_lookup": x4_style_lookup,
}

_BULLET = " OR ".join(f"starts_with(t, '{b}')" for b in BULLETS)
_NUMBER = "|".join(f"(?:{p})" for p in NUMBERED)
_MARKERS = f"""i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) - 1 AS index, {_trim('text')} AS t FROM {_PARSED}),
mk AS (SELECT doc_id, index, ({_BULLET}) AS bullet, regexp_matches(t, '{_NUMBER}') AS numbered FROM i WHERE ({_BULLET}) OR regexp_matches(t, '{_NUMBER}'))"""

_SHOWN = f"(SELECT * FROM {_E} WHERE bounding_box IS NOT NULL AND text IS NOT NULL)"

SQL = {
    "a14_classes": "SELECT DISTINCT doc_id, 'Generic' AS document_type, CAST(0.9 AS DOUBLE) AS confidence FROM text_elements WHERE doc_id IS NOT NULL",
    "a16_titles": f"""WITH n AS (SELECT * FROM {_N} WHERE text_order IS NOT NULL)
SELECT d.doc_id, coalesce((SELECT max(title) FROM document_metadata m WHERE m.doc_id = d.doc_id),
  (SELECT nullif(arg_min({_trim('content.text')}, text_order), '') FROM n WHERE n.doc_id = d.doc_id AND node_type = 'Section')) AS title
FROM (SELECT DISTINCT doc_id FROM n) d""",
    "r22_matching": f"""SELECT doc_id, reading_order, '^Page \\d+' AS pattern, substring(text, 1, 50) AS preview FROM {_E} WHERE regexp_matches(text, '^Page \\d+')
UNION ALL SELECT doc_id, reading_order, '(2', substring(text, 1, 50) FROM {_E} WHERE contains(text, '(2')""",
    "x1_pages": f"SELECT doc_id, count(DISTINCT page_number) AS pages FROM {_SHOWN} GROUP BY 1",
    "x2_paragraphs": f"SELECT doc_id, count(*) AS paragraphs, count(*) AS last FROM (SELECT DISTINCT doc_id, page_number, paragraph_number FROM {_SHOWN}) GROUP BY 1",
    "r23_pattern_sections": f"""SELECT doc_id, reading_order, text FROM {_PARSED}
WHERE ({" OR ".join(f"regexp_matches(text, '{p}')" for p in PATTERNS)})
  AND (style_info.font_size >= CAST({MIN_SIZE} AS FLOAT) OR coalesce(lower(style_info.font_weight) LIKE '%bold%', false))""",
    "r24_markers": f"WITH {_MARKERS} SELECT * FROM mk",
    "r25_sequences": f"""WITH {_MARKERS},
g AS (SELECT *, CASE WHEN index - lag(index) OVER (PARTITION BY doc_id ORDER BY index) <= {LISTS.sequence_lookahead_elements} THEN 0 ELSE 1 END AS new FROM mk),
l AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY index) AS BIGINT) AS list_no FROM g)
SELECT doc_id, list_no, min(index) AS start, max(index) AS last_marker,
  least(max(index) + {LISTS.sequence_boundary_extension}, (SELECT count(*) FROM i WHERE i.doc_id = l.doc_id) - 1) AS end, count(*) AS markers FROM l GROUP BY doc_id, list_no""",
    "r33_oversized": f"""SELECT doc_id, reading_order, length(text) AS characters, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, strlen(text) AS bytes
FROM {_PARSED} WHERE length(text) > {SIZES.max_size}""",
    "o7_uncached": f"""WITH k AS (SELECT *, sha256(sha256(text) || '|{CLI.hash()}|{formats.SCHEMA_VERSION}') AS key FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM k ANTI JOIN (SELECT DISTINCT key FROM k WHERE {IN_TIME}) c USING (key)""",
    "x4_style_lookup": f"""SELECT e.doc_id, e.reading_order, e.style_info.class_name AS class_name, coalesce(f.font_family, 'unknown') AS font_family, CAST(coalesce(f.font_size, 12) AS DOUBLE) AS font_size
FROM {_E} e LEFT JOIN (SELECT DISTINCT doc_id, class_name, font_family, font_size FROM font_classes) f ON f.doc_id = e.doc_id AND f.class_name = e.style_info.class_name""",
}

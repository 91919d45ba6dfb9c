"""Structural checks of parsed elements; elements stay as they are, issues come out as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions.blocks import previous
from folioloom.functions.text import trimmed

PREVIEW = 50


def issues(parsed: DataFrame, max_depth: int, by_page: bool = False) -> DataFrame:
    """doc_id, issue, reading_order, detail. Several issues of one element are several rows.

    ``by_page``: elements follow each other by (page, reading order), as after clustering, else by reading order.
    """
    order = F.coalesce("page_number", F.lit(0)).cast("bigint") * 1_000_000_000 + F.col("reading_order") if by_page else F.col("reading_order")
    p = previous(parsed.withColumn("_o", order), ["doc_id"], "_o", ["hierarchy_level", "reading_order", "page_number"])
    ro, level, page = F.col("reading_order"), F.col("hierarchy_level"), F.col("page_number")
    b = lambda n: F.col(f"bounding_box.{n}")
    size = F.octet_length(trimmed(F.col("text")))
    section = F.col("element_type") == "Section"
    expected = F.coalesce(F.col("prev_reading_order") + 1, F.lit(0))
    box = F.format_string("%.1f,%.1f,%.1f,%.1f", *[F.coalesce(b(n), F.lit(0.0)).cast("double") for n in ("x", "y", "width", "height")])
    checks = (
        ("orphaned_element", level > max_depth, F.substring("text", 1, PREVIEW)),
        ("hierarchy_jump", level > F.col("prev_hierarchy_level") + 1, F.concat_ws(">", F.col("prev_hierarchy_level").cast("string"), level.cast("string"))),
        ("reading_order", (ro < F.greatest(expected - 5, F.lit(0))) | (ro > expected + 10), expected.cast("string")),
        ("invalid_box", (b("x") < 0) | (b("y") < 0) | (b("width") <= 0) | (b("height") <= 0), box),
        ("page_zero", page == 0, F.lit("0")),
        ("page_jump", page > F.col("prev_page_number") + 5, F.concat_ws(">", F.col("prev_page_number").cast("string"), page.cast("string"))),
        ("short_section", section & (size < 3), size.cast("string")),
        ("long_section", section & (size > 200), size.cast("string")),
    )
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue"), d.alias("detail"))) for n, c, d in checks]), lambda x: x.isNotNull())
    return p.select("doc_id", "reading_order", F.inline(found)).select("doc_id", "issue", "reading_order", "detail")


def quality(parsed: DataFrame, max_depth: int, by_page: bool = False) -> DataFrame:
    """doc_id, elements, issues, score: one less the issues' share, 0 at least."""
    n = parsed.groupBy("doc_id").agg(F.count("*").alias("elements"))
    bad = issues(parsed, max_depth, by_page).groupBy("doc_id").agg(F.count("*").alias("issues"))
    return n.join(bad, "doc_id", "left").na.fill(0, ["issues"]).withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("issues") / F.col("elements")))

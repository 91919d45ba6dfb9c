"""Heading detection and contextual hierarchy.

The hierarchy is an ordered fold over heading rows only (state: current level, last size, size of each level); rows
between headings get their level from the heading before by a running count. A ``starting_section_level`` above 1 pads
the list of level sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.config import Headings
from folioloom.functions.blocks import before, fold, kind
from folioloom.functions.text import is_bold, trimmed
from folioloom.session import checkpointed


def mark_headings(parsed: DataFrame, sizes: DataFrame, config: Headings) -> DataFrame:
    """``parsed`` with ``is_heading``; ``sizes`` has doc_id, body_text_size, potential_header_sizes, most_common_font_size."""
    s = sizes.select("doc_id", "body_text_size", "potential_header_sizes", "most_common_font_size")
    size = F.col("style_info.font_size")
    f = lambda x: F.lit(x).cast("float")
    bold = is_bold(F.col("style_info.font_weight"))
    # sizes without style data fall back to 12 points
    body = F.coalesce(F.col("body_text_size"), F.lit(12.0)).cast("float")
    common = F.coalesce(F.col("most_common_font_size"), F.lit(12.0)).cast("float")
    potential = F.exists(F.coalesce("potential_header_sizes", F.array().cast("array<double>")), lambda p: p.cast("float") == size)
    by_bold = F.lit(config.use_bold_indicator) & bold & ((size > common) if config.bold_size_strict else F.lit(True))
    by_style = (size >= f(config.min_header_size)) & ((size > body) | potential | by_bold)
    by_word = F.lit(False)
    for p in config.section_patterns:
        by_word = by_word | F.lower("text").contains(p)
    n = F.octet_length(trimmed(F.col("text")))
    heading = (by_style | by_word) & (n >= 3) & ((n >= 8) | bold | potential)
    return parsed.join(s, "doc_id", "left").select(*parsed.columns, F.coalesce(heading, F.lit(False)).alias("is_heading"))


def next_level(level: int, last: float | None, fonts: list[float], size: float, config: Headings) -> int:
    """The level of a heading of ``size``; updates ``fonts`` in place."""
    if last is None:
        new = config.starting_section_level
        fonts[:] = [0.0] * (new - 1) + [size]
        return new
    if size < last:
        new = level if config.enforce_max_depth and level + 1 > config.max_depth else level + 1
    elif abs(size - last) < config.font_size_tolerance:
        new = level
    else:
        near = (i + 1 for i, f in enumerate(fonts) if abs(f - size) < config.font_size_tolerance)
        under = (i + 1 for i, f in enumerate(fonts) if f < size)
        new = next(near, None) or next(under, 1)
    fonts.extend([0.0] * (new - len(fonts)))
    fonts[new - 1] = size
    return new


def numbered_headings(marked: DataFrame) -> DataFrame:
    """``marked`` with ``heading``, the number of headings before each row."""
    return before(marked, ["doc_id"], "reading_order", F.col("is_heading").cast("int"), "heading")


def heading_levels(marked: DataFrame, config: Headings, numbered: DataFrame | None = None) -> DataFrame:
    """doc_id, heading (its number in the document), level, of every heading; ``numbered`` spares a second count."""
    heads = (numbered_headings(marked) if numbered is None else numbered).filter("is_heading").select("doc_id", "heading", F.col("style_info.font_size").cast("double").alias("size"))

    def step(state: dict, row: dict):
        state["level"] = next_level(state["level"], state["last"], state["fonts"], row["size"], config)
        state["last"] = row["size"]
        yield row["doc_id"], row["heading"], state["level"]

    return fold(heads, ["doc_id"], ["heading"], f"doc_id {kind(heads, 'doc_id')}, heading bigint, level int", lambda: {"level": 1, "last": None, "fonts": []}, step)


def detect_sections(parsed: DataFrame, sizes: DataFrame, config: Headings) -> DataFrame:
    """Headings become sections at their level, everything else lies one level below the last heading (2 before any)."""
    counted = checkpointed(numbered_headings(mark_headings(parsed, sizes, config)))
    levels = heading_levels(counted, config, counted)
    # a content row belongs to the heading before it, a heading row to itself
    numbered = counted.withColumn("heading", F.when(F.col("is_heading"), F.col("heading")).otherwise(F.col("heading") - 1))
    out = numbered.join(levels, ["doc_id", "heading"], "left")
    level = F.when(F.col("is_heading"), F.col("level")).otherwise(F.coalesce("level", F.lit(1)) + 1)
    return out.withColumn("element_type", F.when(F.col("is_heading"), "Section").otherwise(F.col("element_type"))).withColumn("hierarchy_level", level).select(*parsed.columns)

"""Positioned, styled text elements: clean input and base conversion.

Rows that repeat (doc_id, reading_order) are one element; rows without either key are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions.blocks import before
from folioloom.functions.text import trimmed


def elements(text_elements: DataFrame) -> DataFrame:
    """The element table with one row per key."""
    return text_elements.filter("doc_id is not null and reading_order is not null").dropDuplicates(["doc_id", "reading_order"])


def parsed(text_elements: DataFrame) -> DataFrame:
    """Base conversion: every non-blank element as a level 1 paragraph; ``position`` counts the blank ones too."""
    numbered = before(elements(text_elements), ["doc_id"], "reading_order", F.lit(1), "position")
    return numbered.filter(trimmed(F.col("text")) != "").select(
        "doc_id",
        "position",
        F.lit("Paragraph").alias("element_type"),
        "text",
        F.lit(1).alias("hierarchy_level"),
        "style_info",
        "bounding_box",
        "page_number",
        "paragraph_number",
        "reading_order",
        "bookmark_match",
        "token_count",
    )

"""Classification hook and element inspection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators.elements import elements


def classify(text_elements: DataFrame) -> DataFrame:
    """doc_id, document_type, confidence: every document is generic; replace this to choose configurations by type."""
    return text_elements.select("doc_id").filter("doc_id is not null").distinct().select("doc_id", F.lit("Generic").alias("document_type"), F.lit(0.9).alias("confidence"))


def matching(text_elements: DataFrame, patterns: list[str], preview: int = 50) -> DataFrame:
    """doc_id, reading_order, pattern, preview of elements that match a regular expression, or hold it as text if it is none."""
    out = None
    for p in patterns:
        try:
            re.compile(p)
            hit = F.col("text").rlike(p)
        except re.error:
            hit = F.col("text").contains(p)
        rows = elements(text_elements).filter(hit).select("doc_id", "reading_order", F.lit(p).alias("pattern"), F.substring("text", 1, preview).alias("preview"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no patterns")
    return out

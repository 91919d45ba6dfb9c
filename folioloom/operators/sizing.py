"""Size enforcement (opt-in): elements above a limit are split at sentences, lines or positions.

Only oversized elements go to Python, as Arrow batches. Pieces shorter than ``min_size_ratio`` of the limit are dropped,
as the operator is defined; if no piece is left the element stays.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.config import Sizing

SENTENCE_END = re.compile(r"[.!?]+\s+")


def measure(text: Column, unit: str) -> Column:
    """``characters``, ``words`` or ``bytes``; other units count characters."""
    if unit == "words":
        return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.octet_length(text) if unit == "bytes" else F.char_length(text)


def _size(text: str, unit: str) -> int:
    return len(text.split()) if unit == "words" else len(text.encode()) if unit == "bytes" else len(text)


def by_position(text: str, c: Sizing) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = min(at + c.max_size, len(text))
        if end < len(text):
            # the last blank or punctuation mark in the second half of the window
            half = at + c.max_size // 2
            cut = next((k + 1 for k in range(end - 1, half - 1, -1) if text[k].isspace() or (text[k].isascii() and not text[k].isalnum())), end)
            end = max(cut, at + 1)
        part = text[at:end].strip()
        if len(part) >= c.max_size * c.min_size_ratio:
            out.append(part)
        at = end
    return out or [text]


def by_sentence(text: str, c: Sizing) -> list[str]:
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    sentences = [s for s in (text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])) if s.strip()]
    if len(sentences) <= 1:
        return by_position(text, c)
    out, now = [], ""
    for s in sentences:
        if now and _size(now + s, c.size_unit) > c.max_size:
            out.append(now.strip())
            now = ""
        now += s
    out.append(now.strip())
    return [p for p in out if _size(p, c.size_unit) >= c.max_size * c.min_size_ratio] or [text]


def by_line(text: str, c: Sizing) -> list[str]:
    lines = text.split("\n")
    if len(lines) <= 1:
        return by_sentence(text, c)
    out, now = [], []
    for line in lines:
        if now and _size("\n".join([*now, line]), c.size_unit) > c.max_size:
            out.append("\n".join(now))
            now = []
        now.append(line)
    return [*out, "\n".join(now)]


def split_text(text: str, element_type: str, c: Sizing) -> list[str]:
    """Pieces of one text, split again until none is oversized, nothing changes, or the iterations are used up."""
    parts = [text]
    for _ in range(c.max_iterations):
        if all(_size(p, c.size_unit) <= c.max_size for p in parts):
            break
        cut = by_line if element_type == "List" else by_sentence if c.preserve_sentences else by_position
        new = [q for p in parts for q in (cut(p, c) if _size(p, c.size_unit) > c.max_size else [p])]
        if new == parts:
            break
        parts = new
    return parts


def enforce(parsed: DataFrame, config: Sizing, vertical: bool = True) -> DataFrame:
    """``parsed`` with pieces in place of oversized elements, numbered by ``part``; boxes are sliced by the texts' lengths."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, k, config) for t, k in zip(texts, kinds)], dtype=object)

    over = measure(F.col("text"), config.size_unit) > config.max_size
    rows = parsed.withColumn("_over", F.coalesce(over, F.lit(False)))
    rows = rows.withColumn("_parts", F.coalesce(cut(F.when(F.col("_over"), F.col("text")), "element_type"), F.array("text")))
    rows = rows.withColumn("_total", F.aggregate("_parts", F.lit(0), lambda a, p: a + F.coalesce(F.char_length(p), F.lit(0))))
    ahead = F.aggregate(F.slice("_parts", 1, F.col("part")), F.lit(0), lambda a, p: a + F.coalesce(F.char_length(p), F.lit(0)))
    rows = rows.select("*", F.posexplode("_parts").alias("part", "_text")).withColumn("_from", F.when(F.col("part") > 0, ahead).otherwise(F.lit(0)) / F.col("_total")).withColumn("_share", F.char_length("_text") / F.col("_total"))
    b = F.col("bounding_box")
    if vertical:
        box = F.struct(b["x"].alias("x"), (b["y"] + b["height"] * F.col("_from")).alias("y"), b["width"].alias("width"), (b["height"] * F.col("_share")).alias("height"))
    else:
        box = F.struct((b["x"] + b["width"] * F.col("_from")).alias("x"), b["y"].alias("y"), (b["width"] * F.col("_share")).alias("width"), b["height"].alias("height"))
    out = {
        "text": F.col("_text"),
        "bounding_box": F.when(F.size("_parts") > 1, box.cast(parsed.schema["bounding_box"].dataType)).otherwise(b),
        "token_count": F.when(F.size("_parts") > 1, F.floor(F.octet_length("_text") / 4).cast("bigint")).otherwise(F.col("token_count")),
    }
    return rows.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in parsed.columns], "part")

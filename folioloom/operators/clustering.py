"""Merging of spans: into paragraphs by number, then with neighbours by place.

The second step only ever merges inside a page, so its fold runs by (document, page). Boxes are single precision.
Merged elements take type, level, style and position from their first element by reading order.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.config import Clustering
from folioloom.functions.blocks import fold, kind

BOX = "struct<x:float,y:float,width:float,height:float>"


def merge_paragraphs(parsed: DataFrame) -> DataFrame:
    """One row per (document, page, paragraph), whatever the types; rows are ordered by (page, reading order)."""
    rest = [c for c in parsed.columns if c not in ("doc_id", "page_number", "paragraph_number", "text", "bounding_box", "token_count")]
    first = F.min_by(F.struct(*rest), "reading_order")
    x, y = F.col("bounding_box.x"), F.col("bounding_box.y")
    merged = parsed.groupBy("doc_id", "page_number", "paragraph_number").agg(
        first.alias("f"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min(x).alias("x0"),
        F.min(y).alias("y0"),
        F.max(x + F.col("bounding_box.width")).alias("x1"),
        F.max(y + F.col("bounding_box.height")).alias("y1"),
        F.sum("token_count").alias("token_count"),
    )
    box = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return merged.select(*[F.col(f"f.{c}").alias(c) if c in rest else (box.cast(BOX).alias(c) if c == "bounding_box" else F.col(c)) for c in parsed.columns])


def _f32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def union(a: tuple, b: tuple) -> tuple:
    """The box around two boxes (x, y, width, height)."""
    x, y = min(a[0], b[0]), min(a[1], b[1])
    right = max(_f32(a[0] + a[2]), _f32(b[0] + b[2]))
    bottom = max(_f32(a[1] + a[3]), _f32(b[1] + b[3]))
    return x, y, _f32(right - x), _f32(bottom - y)


def adjacent(a: tuple, b: tuple, config: Clustering) -> bool:
    """Whether two boxes touch: a small vertical gap, in either direction, and a union less wide than both and the tolerance."""
    gap = max(0.0, _f32(b[1] - _f32(a[1] + a[3])), _f32(a[1] - _f32(b[1] + b[3])))
    if gap > _f32(_f32(config.min_line_height) * _f32(config.line_height_multiplier)):
        return False
    return union(a, b)[2] < _f32(_f32(a[2] + b[2]) + _f32(config.horizontal_tolerance))


def merge_neighbours(parsed: DataFrame, config: Clustering) -> DataFrame:
    """Greedy merging of each element into the running one of the same type, level and page, up to the type's size in bytes."""
    keep = parsed.select(
        "doc_id", "page_number", "reading_order", "element_type", "hierarchy_level",
        F.octet_length("text").alias("bytes"), "bounding_box.x", "bounding_box.y", "bounding_box.width", "bounding_box.height",
    )

    def step(state: dict, row: dict):
        box = (row["x"], row["y"], row["width"], row["height"])
        kind = (row["element_type"], row["hierarchy_level"])
        most = config.max_section_size if row["element_type"] == "Section" else config.max_paragraph_size
        whole = all(v == v and v is not None for v in box)
        if state and state["kind"] == kind and state["bytes"] + row["bytes"] + 1 <= most and whole and state["whole"] and adjacent(state["box"], box, config):
            state["bytes"] += row["bytes"] + 1
            state["box"] = union(state["box"], box)
        else:
            state.update(kind=kind, bytes=row["bytes"], box=box, whole=whole, head=row["reading_order"])
        b = state["box"] if state["whole"] else (None,) * 4
        yield row["doc_id"], row["page_number"], row["reading_order"], state["head"], *b

    schema = f"doc_id {kind(keep, 'doc_id')}, page_number int, reading_order int, head int, x float, y float, width float, height float"
    heads = fold(keep, ["doc_id", "page_number"], ["reading_order"], schema, dict, step)
    joined = parsed.drop("bounding_box").join(heads, ["doc_id", "page_number", "reading_order"])
    rest = [c for c in parsed.columns if c not in ("doc_id", "page_number", "text", "bounding_box", "token_count")]
    out = joined.groupBy("doc_id", "page_number", "head").agg(
        F.min_by(F.struct(*rest), "reading_order").alias("f"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda s: s["text"]), " ").alias("text"),
        # the running box is that of the last row
        F.max_by(F.struct("x", "y", "width", "height"), "reading_order").alias("bounding_box"),
        F.sum("token_count").alias("token_count"),
    )
    return out.select(*[F.col(f"f.{c}").alias(c) if c in rest else F.col(c) for c in parsed.columns])


def cluster(parsed: DataFrame, config: Clustering) -> DataFrame:
    out = parsed
    if config.enable_paragraph_merging:
        out = merge_paragraphs(out)
    if config.enable_spatial_adjacency:
        out = merge_neighbours(out, config)
    return out

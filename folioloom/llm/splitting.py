"""Splitting oversized texts at natural boundaries (problem 4).

Content-defined chunking: a rolling hash over the last 32 bytes marks landmarks, a cut snaps from its landmark to the
nearest natural boundary, and landmark and boundary lie between a least and a largest size from the previous cut. As
both depend only on the bytes around them, an edit alters the neighbouring pieces and the cuts fall into step again.

A token is four UTF-8 bytes (bytes div 4), as in the limits. Every piece has at most ``max_tokens``; consecutive pieces
share exactly ``overlap_tokens`` (4n to 4n + 3 bytes, so that no character is cut). Without the overlaps the pieces give
the text again.

Defined results: a text within its limit, an empty one, and one without a limit (null, or not positive) is one piece; a
null text gives no row; an overlap of more than half the limit counts as half of it, a null one as 0; rows of the same
document and id are one node; a node whose document has several types (or a type several limits) takes the least limit.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 32
#: The least size of a piece (without its overlap) as a part of the largest one.
LEAST = 4
SALTS = 32
#: Natural boundaries from strong to weak, each ends where a piece may end.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        rb"\n[ \t\r]*\n\s*",
        rb"\n",
        rb"[.!?][\"')\]]*\s+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)\s*",
        rb"[,;:]\s+|\xe3\x80\x81",
        rb"\s+",
    )
)


def _mixed() -> np.ndarray:
    """A fixed pseudo-random number for each byte, by a multiplicative mix."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _mixed()


def rolling(data: bytes) -> np.ndarray:
    """For each position the hash of the (up to) 32 bytes that end there, by doubling windows."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:
        back = np.zeros_like(h)
        back[width:] = h[:-width] << np.uint32(width)
        h = h + back
        width *= 2
    return h


def _snap(data: bytes, low: int, high: int, mark: int) -> int:
    """The natural boundary in low..high nearest to the landmark: of the strongest kind within a quarter of the range, else of any."""
    near = max(16, (high - low) // 4)
    part = data[max(0, low - 4) : high]
    base = max(0, low - 4)
    best = None
    for kind in BOUNDARIES:
        ends = [e for m in kind.finditer(part) if low <= (e := base + m.end()) <= high]
        if ends:
            end = min(ends, key=lambda e: (abs(e - mark), e))
            if abs(end - mark) <= near:
                return end
            if best is None or abs(end - mark) < abs(best - mark):
                best = end
    if best is not None:
        return best
    while mark > low and mark < len(data) and data[mark] & 0xC0 == 0x80:
        mark -= 1
    return mark if mark == len(data) or data[mark] & 0xC0 != 0x80 else next(i for i in range(mark, high + 1) if i == len(data) or data[i] & 0xC0 != 0x80)


def cuts(data: bytes, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """(start, first new byte, end) of each piece."""
    overlap = max(0, min(overlap_tokens, max_tokens // 2))
    if len(data) // 4 <= max_tokens:
        return [(0, 0, len(data))]
    whole = 4 * max_tokens + 3
    most = 4 * (max_tokens - overlap) if overlap else whole
    least = max(1, most // LEAST)
    # half of the range between least and largest size is the expected way to a landmark
    bar = np.uint32(min(2**32 - 1, 2**33 // max(2, most - least)))
    out, at = [], 0
    while True:
        start = at
        if at and overlap:
            start = at - 4 * overlap
            while data[start] & 0xC0 == 0x80:
                start -= 1
        room = whole if at == 0 else most
        if len(data) - at <= room:
            out.append((start, at, len(data)))
            return out
        # the rest is never left shorter than the least size where that can be helped
        low = at + max(least, 1)
        high = min(at + room, max(low, len(data) - least)) if len(data) - at <= room + least else at + room
        first = max(0, low - WINDOW)
        h = rolling(data[first:high])[low - 1 - first :]
        under = np.flatnonzero(h < bar)
        mark = low + int(under[0] if len(under) else np.argmin(h))
        end = _snap(data, low, high, mark)
        out.append((start, at, end))
        at = end


def pieces_of(text: str | None, max_tokens: int | None, overlap_tokens: int | None) -> list[dict] | None:
    """The pieces of one text, with byte offsets."""
    if text is None:
        return None
    data = text.encode()
    found = cuts(data, int(max_tokens), int(overlap_tokens or 0)) if max_tokens and max_tokens > 0 else [(0, 0, len(data))]
    return [
        {"piece": i, "start_byte": s, "new_byte": n, "end_byte": e, "text": data[s:e].decode(), "tokens": (e - s) // 4}
        for i, (s, n, e) in enumerate(found)
    ]


PIECES = "array<struct<piece:int,start_byte:bigint,new_byte:bigint,end_byte:bigint,text:string,tokens:bigint>>"


def split_column(text: Column, max_tokens: Column, overlap_tokens: Column) -> Column:
    """The pieces of a text; only oversized texts go to Python, the others stay in the JVM."""

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pieces_of(t, m, None if pd.isna(o) else o) for t, m, o in zip(texts, most, overlap)], dtype=object)

    size = F.octet_length(text)
    over = (max_tokens > 0) & (F.floor(size / 4) > max_tokens)
    whole = F.array(
        F.struct(
            F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_byte"), F.lit(0).cast("bigint").alias("new_byte"),
            size.cast("bigint").alias("end_byte"), text.alias("text"), F.floor(size / 4).cast("bigint").alias("tokens"),
        )
    )
    return F.coalesce(cut(F.when(over, text), F.when(over, max_tokens), F.when(over, overlap_tokens)), F.when(text.isNotNull(), whole))


def split_nodes(nodes: DataFrame, metadata: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per piece of each node: doc_id, node_id, node_type, max_tokens, overlap_tokens, the piece, and the number of pieces.

    Nodes meet their document's type on (doc_id, a salt of the node id), as one document may hold a third of all
    nodes; repeated rows are removed under the same partitioning.
    """
    n = nodes.filter("content.text is not null and id is not null").select(
        "doc_id", F.col("id").alias("node_id"), "node_type", F.col("content.text").alias("text"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    )
    types = metadata.select("doc_id", "document_type").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    rule = limits.filter("max_tokens > 0").groupBy("document_type", "node_type").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("limit"))
    doc_limits = types.join(rule, "document_type").groupBy("doc_id", "salt", "node_type").agg(F.min("limit").alias("limit"))
    once = n.dropDuplicates(["doc_id", "salt", "node_id"])
    return (
        once.join(doc_limits, ["doc_id", "salt", "node_type"], "left")
        .select("doc_id", "node_id", "node_type", "limit.*", "text")
        .withColumn("pieces", split_column(F.col("text"), F.col("max_tokens"), F.col("overlap_tokens")))
        .select("doc_id", "node_id", "node_type", "max_tokens", "overlap_tokens", F.size("pieces").alias("n_pieces"), F.inline("pieces"))
    )

"""Mixing sources to target shares of the tokens (problem 6).

Systematic sampling inside each source: every record expects the same number of copies, the record of rank r covers
the stretch from r to r + 1 copies' worth, one random offset shifts the source's scale, and a record is emitted once
for each whole number that its stretch crosses. A record so gets the floor or the ceiling of what it expects and never
more than its source's ``max_repeats``. Ranks run by size class, hash block and size, so that large and small records are
drawn evenly and a source's tokens come out close to its share.

The total is ``total_tokens``, by default all tokens of the sources that have a target. A source whose share of it
would need more than ``max_repeats`` uses of its records gives all of them ``max_repeats`` times; its shortfall stays
and is reported, the other sources keep their numbers of tokens.

Defined results: sources without a target (null too) give nothing; a target without records is reported with 0 tokens;
null texts are no records, empty ones count 0 tokens; null shares or repeats count as 0; of repeated target rows for a
source the largest (target_share, max_repeats) counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.ranks import ranked
from folioloom.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from folioloom.session import checkpointed

ROWS_A_BLOCK = 50_000


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(records, shares): one row (id, source, copy, tokens) per use of a record, and the shares asked and reached."""
    sizes = checkpointed(
        documents.select(F.col(id_col).alias("item"), F.col(source_col).alias("source"), token_count(F.col(text_col), folder, vocabulary).alias("tokens")).filter("tokens is not null")
    )
    goals = targets.groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))).alias("t")).filter("source is not null").select("source", "t.*")
    have = sizes.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available"))
    goals = goals.join(have, "source", "left").na.fill(0, ["records", "available"])
    wanted = goals.collect()  # one row per target
    total = sum(r.available for r in wanted) if total_tokens is None else total_tokens
    rates = [
        (r.source, r.share, r.repeats, r.records, r.available, min(float(r.repeats), r.share * total / r.available) if r.available else 0.0)
        for r in wanted
    ]
    rate = documents.sparkSession.createDataFrame(rates, "source string, target_share double, max_repeats int, records bigint, available_tokens bigint, rate double")
    known = sizes.join(F.broadcast(rate.select("source", "rate")) if len(rates) <= 10_000 else rate.select("source", "rate"), "source")
    # a third of all records may have one source: ranks are taken by blocks
    blocks = max(1, max((r.records for r in wanted), default=0) // ROWS_A_BLOCK)
    order = ranked(known, ["source"], ["tokens", "item"], blocks, F.floor(F.log2(F.col("tokens") + 1)).cast("int"))
    # the offset is drawn per source, from the seed
    shift = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor((F.col("rank") + 1) * F.col("rate") + shift) - F.floor(F.col("rank") * F.col("rate") + shift)
    used = order.withColumn("copies", copies.cast("int"))
    records = used.filter("copies > 0").select(
        F.col("item").alias(id_col), "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens"
    )
    got = used.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    shares = (
        rate.join(got, "source", "left")
        .na.fill(0, ["used_tokens", "most_copies"])
        .withColumn("all_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))  # one row a target
        .select(
            "source",
            "target_share",
            "max_repeats",
            "records",
            "available_tokens",
            "used_tokens",
            "most_copies",
            F.coalesce(F.col("used_tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)).alias("actual_share"),
            ((F.col("rate") >= F.col("max_repeats")) | ((F.col("target_share") > 0) & (F.col("available_tokens") == 0))).alias("short"),
        )
    )
    return records, shares

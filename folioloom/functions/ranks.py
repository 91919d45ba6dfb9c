"""Global ranks without a global sort or one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, groups: list[str], order: list[str], blocks: int, stratum: Column | None = None, name: str = "rank") -> DataFrame:
    """``df`` with a 0-based rank inside each group, a bijection onto 0..n-1.

    A group's rows are cut into ``blocks`` hash blocks (inside each value of ``stratum``, which orders the blocks),
    each ranked on its own by ``order``; the blocks' row counts are then summed up in front of each block. So a group
    that holds most rows still spreads over many tasks, and what a single task sums is the block counts of one
    group. Ties in ``order`` are broken by ``order`` itself only if it is unique; give unique columns for stable ranks.
    """
    keyed = df.withColumn("_stratum", stratum if stratum is not None else F.lit(0)).withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    at = [*groups, "_stratum", "_block"]
    sizes = keyed.groupBy(*at).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_stratum", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1)
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in at]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return (
        local.alias("l").join(starts.alias("s"), on)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("s._start") + F.col("l._local")).alias(name))
    )

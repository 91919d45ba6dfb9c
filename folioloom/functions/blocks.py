"""Order-dependent computations over documents of any size.

A document may hold a third of all rows, so windows never run over a whole document. Counts and sums before a row run
in blocks of the document's order plus one summary row a block; folds that need state run streaming over sorted
partitions with constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096


def before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys that come before, by (order, ties)."""
    b = df.withColumn("_v", value.cast("bigint")).withColumn("_b", F.floor(F.col(order) / BLOCK))
    at = [*keys, "_b"]
    sums = b.groupBy(*at).agg(F.sum("_v").alias("_s"))
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_s", F.coalesce(F.sum("_s").over(up_to), F.lit(0)))
    inside = Window.partitionBy(*at).orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumn("_l", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(starts, at).withColumn(name, F.col("_s") + F.col("_l")).drop("_v", "_b", "_s", "_l").select(*df.columns, name)


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with prev_<column>: the values of the row before, by ``order`` inside the keys; null in the first row."""
    b = df.withColumn("_b", F.floor(F.col(order) / BLOCK))
    row = F.struct(*columns)
    at = [*keys, "_b"]
    lasts = b.groupBy(*at).agg(F.max_by(row, order).alias("_last"))
    bridge = lasts.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    local = b.withColumn("_prev", F.lag(row).over(Window.partitionBy(*at).orderBy(order)))
    out = local.join(bridge, at).withColumn("_prev", F.coalesce("_prev", "_last"))
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    # objects keep whole numbers beside nulls whole
    return pd.DataFrame(rows, columns=columns, dtype=object)


def kind(df: DataFrame, column: str) -> str:
    """The column's type in DDL, for the schemas of folds over keys of any type."""
    return df.schema[column].dataType.simpleString()


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable, finish: Callable | None = None) -> DataFrame:
    """An ordered fold inside each group of ``keys``; ``step(state, row) -> iterable of output tuples``.

    Rows stream through in sorted partitions, so memory holds one state and one batch; ``finish(state)`` may emit more
    when a group ends. Rows are named tuples of the input's columns.
    """
    names = df.columns
    key_at = [names.index(k) for k in keys]
    fields = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, cols = None, None, fields
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(row[i] for i in key_at)
                if key != now or state is None:
                    if state is not None and finish:
                        out.extend(finish(state))
                    now, state = key, start()
                out.extend(step(state, dict(zip(names, row))))
            yield _frame(out, cols)
        if state is not None and finish:
            yield _frame(list(finish(state)), cols)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)

"""Filling fixed-capacity containers with texts (problem 5).

Item sizes are whole numbers up to the capacity, so everything the packing decides depends only on how many items
there are of each size. That histogram (at most capacity + 1 rows, however large the corpus) is planned on the driver
by large-item matching:

* items above a third of the capacity go at most two to a container: from the largest on, each is paired with the
  largest other one that still fits, whole runs of equal sizes at a time;
* smaller items, from the largest on, go to the container with the least gap that takes them, again whole runs at a
  time, and open new containers only when no gap does.

The plan says of the k-th item of a size which container it goes to; items get their k by distributed ranks, so no
task ever holds a size or a container set of its own.

Defined results: a text larger than the capacity gives full containers of its own and a last piece that is packed like
any item; null texts are no items; empty texts (0 tokens) are items of size 0 and all go to container 0, which is
there if nothing else is; repeated ids are separate items; packs with a null or non-positive capacity give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions.ranks import ranked
from folioloom.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from folioloom.session import checkpointed

ROWS_A_BLOCK = 50_000
#: A plan of up to so many rows (some 50 bytes each) is broadcast.
BROADCAST_ROWS = 100_000


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (size, first rank, containers, items in each, first container), and the number of containers."""
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    bins = 0

    def give(size: int, first: int, many: int, each: int) -> None:
        runs.append((size, used[size], many, each, first))
        used[size] += many * each

    def leave(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, many))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        if at >= 0 and large[at] == a and left[a] == 1:
            at -= 1
        if at < 0:
            many, b = left[a], None
        else:
            b = large[at]
            many = left[a] // 2 if b == a else min(left[a], left[b])
        give(a, bins, many, 2 if b == a else 1)
        left[a] -= many * (2 if b == a else 1)
        if b is not None and b != a:
            give(b, bins, many, 1)
            left[b] -= many
            if not left[b]:
                large.remove(b)
        leave(capacity - a - (b or 0), bins, many)
        bins += many
        if not left[a]:
            large.remove(a)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(open_gaps, s)
            if at == len(open_gaps):
                gap, first, many = capacity, bins, -(-n // (capacity // s))
                bins += many
            else:
                gap = open_gaps[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            each = gap // s
            full = min(many, n // each)
            if full:
                give(s, first, full, each)
                leave(gap - each * s, first, full)
                n -= full * each
            if full < many and n:
                give(s, first + full, 1, n)
                leave(gap - n * s, first + full, 1)
                leave(gap, first + full + 1, many - full - 1)
                n = 0
            elif full < many:
                leave(gap, first + full, many - full)
    if counts.get(0):
        runs.append((0, 0, 1, counts[0], 0))
        bins = max(bins, 1)
    return runs, bins


def pack(documents: DataFrame, packs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per item: pack_name, container, id, piece, first_token, tokens.

    ``packs`` has pack_name and capacity_tokens and is small (its rows are read on the driver).
    """
    spark = documents.sparkSession
    sizes = checkpointed(
        documents.select(F.col(id_col).alias("item"), token_count(F.col(text_col), folder, vocabulary).alias("size")).filter("size is not null")
    )
    wanted = {r[0]: r[1] for r in packs.select("pack_name", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0}
    each = F.array(*[F.struct(F.lit(k).alias("pack_name"), F.lit(int(c)).alias("capacity")) for k, c in wanted.items()])
    schema = "pack_name string, container bigint, item bigint, piece int, first_token bigint, tokens bigint"
    if not wanted:
        return spark.createDataFrame([], schema).withColumnRenamed("item", id_col)
    # a large text gives full pieces and what is left over; the other texts give one piece
    full = F.expr("size div capacity")
    over = F.expr("size % capacity")
    pieces = sizes.withColumn("p", F.explode(each)).select("item", "size", "p.*").select(
        "pack_name",
        "item",
        F.inline(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.greatest(full - F.when((over == 0) & (full > 0), 1).otherwise(0), F.lit(0))),
                lambda k: F.struct(
                    k.cast("int").alias("piece"),
                    (k * F.col("capacity")).alias("first_token"),
                    F.least(F.col("capacity").cast("bigint"), F.col("size") - k * F.col("capacity")).alias("tokens"),
                ),
            )
        ),
    )
    counts: dict[str, dict[int, int]] = {k: {} for k in wanted}
    for r in pieces.groupBy("pack_name", "tokens").count().collect():  # at most capacity + 1 rows a pack
        counts[r[0]][r[1]] = r[2]
    plans = []
    for name, capacity in wanted.items():
        plans += [(name, *run) for run in plan(counts[name], capacity)[0]]
    runs = spark.createDataFrame(plans, "pack_name string, tokens bigint, start bigint, many bigint, each bigint, first bigint")
    total = sum(n for c in counts.values() for n in c.values())
    items = ranked(pieces, ["pack_name", "tokens"], ["item", "piece"], max(1, total // ROWS_A_BLOCK))
    # the plan's rows of a size are few; they are joined as one array so that the items are read once
    runs = runs.groupBy("pack_name", "tokens").agg(F.sort_array(F.collect_list(F.struct("start", "many", "each", "first"))).alias("runs"))
    # as many rows as there are sizes: bounded by the capacities, whatever the corpus; only huge capacities are shuffled
    if len(plans) <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    own = F.element_at(F.filter("runs", lambda r: r["start"] <= F.col("rank")), -1)
    return (
        items.join(runs, ["pack_name", "tokens"])
        .withColumn("run", own)
        .select(
            "pack_name",
            F.expr("run.first + (rank - run.start) div run.each").alias("container"),
            F.col("item").alias(id_col),
            "piece",
            "first_token",
            "tokens",
        )
    )


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: items, containers, tokens, the least number of containers the tokens need, and the share of unused space."""
    per = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return (
        per.groupBy("pack_name")
        .agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.max("tokens").alias("fullest"))
        .join(packs.select("pack_name", "capacity_tokens").distinct(), "pack_name")
        .select(
            "pack_name",
            "capacity_tokens",
            "items",
            "containers",
            "tokens",
            "fullest",
            F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("containers_at_least"),
            (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"),
        )
    )

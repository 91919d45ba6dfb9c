"""Structural profile of documents or of any subset of their nodes.

Works on rows with doc_id, node_type, depth and token_count; repeated node rows must be removed before. Histogram bins
are equal-width over the token range; a value equal to the maximum falls out of the last bin if the range is an exact
multiple of the width, as the data model defines them. Empty bins stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id: doc_id, id, node_type, depth, token_count, page, text_order, text, parent, path."""
    return nodes.filter("id is not null").dropDuplicates(["doc_id", "id"]).select(
        "doc_id", "id", "node_type", F.col("location.semantic.depth").alias("depth"), F.coalesce("token_count", F.lit(0)).cast("bigint").alias("token_count"),
        F.col("location.physical.page").alias("page"), "text_order", F.col("content.text").alias("text"), "parent", F.col("location.semantic.path").alias("path"),
    )


def _width(low: Column, high: Column) -> Column:
    return F.greatest(F.ceil((high - low) / BINS), F.lit(1)).cast("bigint")


def histograms(flat: DataFrame) -> DataFrame:
    """doc_id, node_type (null: all nodes), bin, range_start, range_end, count, token_sum; two grouping sets in one pass.

    Values are counted first, so that the join with the ranges runs over distinct values.
    """
    values = (
        flat.withColumn("sets", F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("t")), F.struct(F.lit(False).alias("whole"), F.col("node_type").alias("t"))))
        .select("doc_id", F.explode("sets").alias("s"), F.col("token_count").alias("v"))
        .groupBy("doc_id", "s.whole", "s.t", "v")
        .agg(F.count("*").alias("n"))
    )
    by = values.groupBy("doc_id", "whole", "t")
    doc = by.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    w = _width(F.col("low"), F.col("high"))
    doc = doc.withColumn("w", w).withColumn("nb", F.greatest(F.ceil((F.col("high") - F.col("low")) / w), F.lit(1)).cast("int"))
    bins = doc.withColumn(
        "bins",
        F.transform(
            F.sequence(F.lit(0), F.col("nb") - 1),
            lambda i: F.struct(
                i.alias("bin"),
                (F.col("low") + i * F.col("w")).alias("range_start"),
                F.least(F.col("low") + (i + 1) * F.col("w"), F.col("high") + 1).alias("range_end"),
            ),
        ),
    ).select("doc_id", "whole", "t", "low", "high", "w", "nb", F.inline("bins"))
    at = values.alias("v").join(doc.select("doc_id", "whole", "t", "low", "high", "w", "nb").alias("d"), F.col("v.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("v.whole") == F.col("d.whole")) & F.col("v.t").eqNullSafe(F.col("d.t")))
    inside = (F.col("d.low") == F.col("d.high")) | (F.col("v.v") < F.col("d.low") + F.col("d.nb") * F.col("d.w"))
    counted = (
        at.filter(inside)
        .select("v.doc_id", "v.whole", "v.t", F.expr("cast((v.v - d.low) div d.w as int)").alias("bin"), "v.n", F.col("v.v").alias("v"))
        .groupBy("doc_id", "whole", "t", "bin")
        .agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("v")).alias("token_sum"))
    )
    on = F.col("b.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("b.whole") == F.col("c.whole")) & F.col("b.t").eqNullSafe(F.col("c.t")) & (F.col("b.bin") == F.col("c.bin"))
    return bins.alias("b").join(counted.alias("c"), on, "left").select(
        "b.doc_id", F.col("b.whole").alias("overall"), F.col("b.t").alias("node_type"), "b.bin", "b.range_start", "b.range_end",
        F.coalesce("c.count", F.lit(0)).alias("count"), F.coalesce("c.token_sum", F.lit(0)).alias("token_sum"),
    )


def token_statistics(flat: DataFrame) -> DataFrame:
    """doc_id, overall, node_type, total_count, total_tokens, mean, median, mode, variance.

    The mode is the start of the last fullest bin; the variance is the sample's, 0 for a single node.
    """
    sets = flat.withColumn("sets", F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("t")), F.struct(F.lit(False).alias("overall"), F.col("node_type").alias("t"))))
    rows = sets.select("doc_id", F.explode("sets").alias("s"), "token_count")
    stats = rows.groupBy("doc_id", "s.overall", F.col("s.t").alias("node_type")).agg(
        F.count("*").alias("total_count"), F.sum("token_count").alias("total_tokens"), F.avg("token_count").alias("mean"),
        F.median("token_count").alias("median"), F.coalesce(F.var_samp("token_count"), F.lit(0.0)).alias("variance"),
    )
    modes = histograms(flat).groupBy("doc_id", "overall", "node_type").agg(F.max_by("range_start", F.struct("count", "range_start")).alias("mode"))
    on = F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.overall") == F.col("m.overall")) & F.col("s.node_type").eqNullSafe(F.col("m.node_type"))
    return stats.alias("s").join(modes.alias("m"), on).select("s.*", "m.mode")


def type_distribution(flat: DataFrame) -> DataFrame:
    """doc_id, node_type, n, percentage."""
    counts = flat.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))
    totals = counts.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "doc_id").select("doc_id", "node_type", "n", (F.col("n") / F.col("total") * 100).alias("percentage"))


def depth_distribution(flat: DataFrame) -> DataFrame:
    """doc_id, depth, n."""
    return flat.groupBy("doc_id", "depth").agg(F.count("*").alias("n"))


def profile(flat: DataFrame) -> DataFrame:
    """One row a document: totals, depths, type and depth counts."""
    docs = flat.groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"), F.sum("token_count").alias("total_tokens"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.avg("depth").alias("avg_depth")
    )
    types = type_distribution(flat).filter("node_type is not null").groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_type", "n")))).alias("type_counts"))
    depths = depth_distribution(flat).filter("depth is not null").groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("depth", "n")))).alias("depth_counts"))
    return docs.join(types, "doc_id", "left").join(depths, "doc_id", "left").withColumn("document_type", F.lit("Generic")).withColumn("flow_type", F.lit("Fixed"))


def structural(flat: DataFrame, created_at: Column | None = None) -> DataFrame:
    """doc_id, structural_profile: the data model's profile with its distributions, one struct a document.

    ``created_at`` is the time of writing unless given. ``flat`` is read several times.
    """
    f = lambda c: F.col(c).cast("float").alias(c)
    i = lambda c: F.col(c).cast("int").alias(c)
    bins = histograms(flat).groupBy("doc_id", "overall", "node_type").agg(F.sort_array(F.collect_list(F.struct("bin", i("range_start"), i("range_end"), "count", "token_sum"))).alias("bins"))
    on = F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.overall") == F.col("b.overall")) & F.col("s.node_type").eqNullSafe(F.col("b.node_type"))
    hists = token_statistics(flat).alias("s").join(bins.alias("b"), on).select("s.*", F.transform("b.bins", lambda x: x.dropFields("bin")).alias("bins"))
    hist = F.struct("bins", "total_count", "total_tokens", f("mean"), f("median"), i("mode"), f("variance"))
    tokens = hists.groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("overall") & F.col("node_type").isNotNull(), F.struct("node_type", hist.alias("h")))))).alias("by_node_type"),
        F.max(F.when(F.col("overall"), hist)).alias("overall"),
    )
    shares = type_distribution(flat).filter("node_type is not null").groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_type", f("percentage"))))).alias("percentages"))
    created = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if created_at is None else created_at
    return profile(flat).join(tokens, "doc_id", "left").join(shares, "doc_id", "left").select(
        "doc_id",
        F.struct(
            created.alias("created_at"), "document_type", "flow_type", "total_nodes", "total_tokens",
            F.struct("by_node_type", "overall").alias("token_distribution"),
            F.struct(F.col("type_counts").alias("counts"), "percentages").alias("node_type_distribution"),
            F.struct(i("max_depth"), "depth_counts", f("avg_depth")).alias("depth_distribution"),
        ).alias("structural_profile"),
    )


def subtree_nodes(flat: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of the subtrees of ``roots`` (doc_id, id), with the subtree's root as ``top``.

    A node's path starts with its ancestors' paths, so every node looks up its own prefixes; no recursion, no range join.
    """
    tops = flat.join(roots.select("doc_id", "id").distinct(), ["doc_id", "id"]).select("doc_id", F.col("id").alias("top"), F.col("path").alias("prefix"))
    parts = F.split("path", r"\.")
    prefixes = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))
    )
    return flat.withColumn("prefix", F.explode(prefixes)).join(tops, ["doc_id", "prefix"]).drop("prefix")

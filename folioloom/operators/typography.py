"""Typography of documents: size, family, weight and class statistics.

Ties for the most common size go to the smaller size, for families and classes to the smaller name. Sizes are grouped
by their one-decimal text or rounded to two decimals. Documents without elements give no rows; elements without a
style count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.text import is_bold, is_italic, one_decimal
from folioloom.operators.elements import elements

RARE_SHARE = 0.1


def _styled(text_elements: DataFrame) -> DataFrame:
    return elements(text_elements).select("doc_id", "reading_order", "style_info.*").filter("font_size is not null")


def size_counts(text_elements: DataFrame) -> DataFrame:
    """doc_id, font_size (text, one decimal), n."""
    return _styled(text_elements).groupBy("doc_id", one_decimal(F.col("font_size")).alias("font_size")).agg(F.count("*").alias("n"))


def family_counts(text_elements: DataFrame) -> DataFrame:
    return _styled(text_elements).groupBy("doc_id", "font_family").agg(F.count("*").alias("n"))


def class_counts(text_elements: DataFrame) -> DataFrame:
    """Uses of every class, of classes without style data too."""
    return _styled(text_elements).groupBy("doc_id", "class_name").agg(F.count("*").alias("n"))


def weight_counts(text_elements: DataFrame) -> DataFrame:
    """doc_id, bold, not_bold, italic, not_italic."""
    bold, italic = is_bold(F.col("font_weight")), is_italic(F.col("font_style"))
    return _styled(text_elements).groupBy("doc_id").agg(
        F.count_if(bold).alias("bold"), F.count_if(~bold).alias("not_bold"), F.count_if(italic).alias("italic"), F.count_if(~italic).alias("not_italic")
    )


def _most(key: str, rank: Column) -> Column:
    return F.max_by(key, F.struct(F.col("n"), rank))


def document_analysis(text_elements: DataFrame) -> DataFrame:
    """One row a document: maps of counts, bold and italic counts, most common size and family, all sizes sorted."""
    sizes = size_counts(text_elements).groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("font_size", "n")))).alias("font_size_counts"),
        _most("font_size", -F.col("font_size").cast("double")).cast("float").alias("most_common_font_size"),
    )
    families = family_counts(text_elements)
    best = families.withColumn("r", F.struct((-F.col("n")).alias("a"), F.col("font_family").alias("b")))
    families = best.groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("font_family", "n")))).alias("font_family_counts"),
        F.coalesce(F.min("r")["b"], F.lit("unknown")).alias("most_common_font_family"),
    )
    every = size_runs(text_elements)
    return sizes.join(families, "doc_id").join(weight_counts(text_elements), "doc_id").join(every, "doc_id", "left")


def size_runs(text_elements: DataFrame) -> DataFrame:
    """All sizes sorted, as runs (size, n): as long as a document's distinct sizes, not as its elements."""
    runs = _styled(text_elements).groupBy("doc_id", "font_size").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("font_size", "n"))).alias("all_font_sizes"))


def known_sizes(text_elements: DataFrame, font_classes: DataFrame) -> DataFrame:
    """doc_id, size, n: uses of the classes that have style data, by size rounded to two decimals."""
    classes = font_classes.filter("class_name is not null").groupBy("doc_id", "class_name").agg(F.max("font_size").alias("size"))
    return (
        class_counts(text_elements)
        .join(classes, ["doc_id", "class_name"])
        .groupBy("doc_id", F.round(F.col("size").cast("double"), 2).alias("size"))
        .agg(F.sum("n").alias("n"))
    )


def font_size_analysis(text_elements: DataFrame, font_classes: DataFrame) -> DataFrame:
    """One row a document: median, extremes, body size, rare large and possible heading sizes, levels and usage ratio.

    The median is the upper one, taken from the sorted sizes' running counts.
    """
    sizes = known_sizes(text_elements, font_classes)
    doc = sizes.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("size", "n"))).alias("sizes"),
        F.sum("n").alias("total"),
        F.max("n").alias("max_n"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.max_by("size", F.struct("n", -F.col("size"))).alias("body_text_size"),
    )
    up_to = lambda x: F.aggregate(F.filter("sizes", lambda s: s["size"] <= x["size"]), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    median = F.element_at(F.filter("sizes", lambda x: up_to(x) > F.expr("total div 2")), 1)["size"]
    doc = doc.withColumn("median_size", median)
    limit = F.greatest(F.floor(F.col("total") * RARE_SHARE), F.lit(1))
    pick = lambda keep: F.reverse(F.transform(F.filter("sizes", keep), lambda s: s["size"]))
    return doc.select(
        "doc_id",
        "median_size",
        "min_size",
        "max_size",
        "body_text_size",
        pick(lambda s: (s["size"] > F.col("median_size")) & (s["n"] <= limit)).alias("rare_large_sizes"),
        pick(lambda s: (s["size"] > F.col("body_text_size")) & (s["n"] < F.expr("max_n div 2"))).alias("potential_header_sizes"),
        F.reverse("sizes").alias("hierarchy_levels"),
        (F.col("max_n") / F.col("total")).alias("size_usage_ratio"),
    )

"""The rooted, ordered tree of a document.

Parents come from a stack fold. A row of level 1 or less resets the stack to the root, so the fold runs by (document,
segment between resets) and large documents spread over many tasks; only the ordinals of the root's children are
counted over the whole document, by blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.blocks import before, fold, kind
from folioloom.functions.text import is_bold, is_italic, trimmed

ROOT_TEXT = "Document"


def node_id(doc: Column, order: Column) -> Column:
    """A deterministic id."""
    return F.sha2(F.concat_ws(":", doc.cast("string"), order.cast("string")), 256)


def ordered(parsed: DataFrame) -> DataFrame:
    """``parsed`` with text_order: its 0-based place by (page, reading order)."""
    pages = parsed.withColumn("_o", F.col("page_number").cast("bigint") * 1_000_000_000 + F.col("reading_order"))
    return before(pages, ["doc_id"], "_o", F.lit(1), "text_order").drop("_o").withColumn("text_order", F.col("text_order").cast("int"))


def placed(parsed: DataFrame) -> DataFrame:
    """doc_id, text_order, parent_order (-1: the root), path, crumbs (texts of the sections above, itself too if one)."""
    rows = ordered(parsed).select(
        "doc_id", "text_order", "element_type", F.col("hierarchy_level").alias("level"), F.when(F.col("element_type") == "Section", trimmed(F.col("text"))).alias("title")
    )
    reset = (F.col("level") <= 1).cast("int")
    rows = before(rows, ["doc_id"], "text_order", reset, "segment").withColumn("segment", F.col("segment") + reset)

    def step(state: dict, row: dict):
        # stack entries: (order, level, path below the root's child, children so far, crumbs)
        stack, level = state["stack"], row["level"]
        if level <= 1:
            del stack[1:]
        else:
            while len(stack) > max(level, 1):
                stack.pop()
        section = row["element_type"] == "Section"
        top = stack[-1]
        top[3] += 1
        if top[0] < 0:
            path = None  # the ordinal among the root's children is counted later
            head = row["text_order"]
        else:
            path = f"{top[2]}.{top[3]}" if top[2] else str(top[3])
            head = top[5]
        crumbs = [*top[4], row["title"]] if section else top[4]
        if section:
            # the parent is what the depth of the stack gives; only then sections of the same level or below are closed
            while len(stack) > 1 and stack[-1][1] >= level:
                stack.pop()
            stack.append([row["text_order"], level, path, 0, crumbs, head])
        yield row["doc_id"], row["text_order"], top[0], head, path, list(crumbs)

    schema = f"doc_id {kind(rows, 'doc_id')}, text_order int, parent_order int, head int, below string, crumbs array<string>"
    out = fold(rows, ["doc_id", "segment"], ["text_order"], schema, lambda: {"stack": [[-1, 0, "", 0, [], -1]]}, step)
    tops = before(out.filter("parent_order = -1").select("doc_id", "text_order"), ["doc_id"], "text_order", F.lit(1), "ordinal").select("doc_id", F.col("text_order").alias("head"), "ordinal")
    return out.join(tops, ["doc_id", "head"]).select(
        "doc_id", "text_order", "parent_order", F.concat_ws(".", (F.col("ordinal") + 1).cast("string"), "below").alias("path"), "crumbs"
    )


def build(parsed: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The node table: id, node_type, location, text_order, content, style_info, token_count, parent, children.

    ``titles`` (doc_id, title) starts the breadcrumbs where a title is not empty.
    """
    rows = ordered(parsed)
    place = placed(parsed)
    doc = F.col("doc_id")
    root = F.lit("root")
    ident = lambda o: F.when(o < 0, node_id(doc, root)).otherwise(node_id(doc, o))
    kids = place.groupBy("doc_id", "parent_order").agg(F.transform(F.array_sort(F.collect_list("text_order")), lambda o: o).alias("kids"))
    kids = kids.withColumnRenamed("parent_order", "text_order")
    style = F.struct(
        F.col("style_info.class_name").alias("font_class"), F.col("style_info.font_size").alias("font_size"), is_bold(F.col("style_info.font_weight")).alias("is_bold"),
        is_italic(F.col("style_info.font_style")).alias("is_italic"), F.col("style_info.font_family").alias("font_family"), F.col("style_info.color").alias("color"),
    )
    docs = parsed.select("doc_id").distinct()
    docs = docs.join(titles, "doc_id", "left") if titles is not None else docs.withColumn("title", F.lit(None).cast("string"))
    start = F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(F.array().cast("array<string>"))
    content = rows.join(place, ["doc_id", "text_order"]).join(docs, "doc_id").join(kids, ["doc_id", "text_order"], "left")
    ids = lambda: F.transform(F.coalesce("kids", F.array().cast("array<int>")), lambda o: node_id(doc, o))
    nodes = content.select(
        "doc_id",
        node_id(doc, F.col("text_order")).alias("id"),
        F.col("element_type").alias("node_type"),
        F.struct(
            F.struct("path", F.col("hierarchy_level").alias("depth"), F.concat(start, "crumbs").alias("breadcrumbs")).alias("semantic"),
            F.struct(F.col("page_number").alias("page"), "bounding_box").alias("physical"),
        ).alias("location"),
        "text_order",
        F.struct(trimmed(F.col("text")).alias("text")).alias("content"),
        style.alias("style_info"),
        "token_count",
        ident(F.col("parent_order")).alias("parent"),
        ids().alias("children"),
    )
    roots = docs.join(kids.filter("text_order = -1").drop("text_order"), "doc_id", "left").select(
        "doc_id",
        node_id(doc, root).alias("id"),
        F.lit(ROOT_TEXT).alias("node_type"),
        F.struct(
            F.struct(F.lit("").alias("path"), F.lit(0).alias("depth"), start.alias("breadcrumbs")).alias("semantic"),
            F.lit(None).cast(nodes.schema["location"].dataType["physical"].dataType).alias("physical"),
        ).alias("location"),
        F.lit(None).cast("int").alias("text_order"),
        F.struct(F.lit(ROOT_TEXT).alias("text")).alias("content"),
        F.lit(None).cast(nodes.schema["style_info"].dataType).alias("style_info"),
        F.lit(0).cast("bigint").alias("token_count"),
        F.lit(None).cast("string").alias("parent"),
        ids().alias("children"),
    )
    return roots.unionByName(nodes)


def subtree_ranges(nodes: DataFrame) -> DataFrame:
    """doc_id, id, first, last: a node's subtree is the text orders first..last, as trees are in preorder.

    By path prefixes: every node counts for each of its ancestors' paths.
    """
    n = nodes.select("doc_id", "id", "text_order", F.col("location.semantic.path").alias("path"))
    parts = F.split("path", r"\.")
    above = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))
    )
    spans = n.select("doc_id", "text_order", F.explode(above).alias("path")).groupBy("doc_id", "path").agg(F.min("text_order").alias("first"), F.max("text_order").alias("last"))
    return n.select("doc_id", "id", "path").join(spans, ["doc_id", "path"]).select("doc_id", "id", "first", "last")


def infer_titles(parsed: DataFrame) -> DataFrame:
    """doc_id, title: the first section's trimmed text; null if that is empty."""
    s = parsed.filter("element_type = 'Section'")
    key = F.struct("page_number", "reading_order")
    return s.groupBy("doc_id").agg(F.nullif(F.min_by(trimmed(F.col("text")), key), F.lit("")).alias("title"))


def merge_titles(parsed: DataFrame, metadata: DataFrame) -> DataFrame:
    """The inferred title, which the metadata's title replaces where that isn't null (an empty one too)."""
    given = metadata.groupBy("doc_id").agg(F.max("title").alias("given"))
    docs = parsed.select("doc_id").distinct()
    return docs.join(infer_titles(parsed), "doc_id", "left").join(given, "doc_id", "left").select("doc_id", F.coalesce("given", "title").alias("title"))


def merge_metadata(inferred: DataFrame, given: DataFrame) -> DataFrame:
    """One row a document: each field of ``inferred`` that ``given`` replaces where it has a value (a page count only above 0).

    An empty string is a value. Of several given rows the largest value of each field counts.
    """
    names = [c for c in inferred.columns if c != "doc_id"]
    both = [c for c in names if c in given.columns]
    value = lambda c: F.when(F.col(c) > 0, F.col(c)) if c == "page_count" else F.col(c)
    rows = given.groupBy("doc_id").agg(F.max(F.lit(1)).alias("_n"), *[F.max(value(c)).alias(f"_{c}") for c in both])
    out = inferred.join(rows, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in both else F.col(c) for c in names])

"""Deeply nested semi-structured records to related flat tables (problem 1).

A payload holds a graph in one of three layouts (a list of nodes, nodes keyed by id, or one root with nested
children), at any place inside other objects, lists and JSON strings. A fold looks for the graph level by level; another one
brings every layout to one array of node structs by nested ``transform`` calls that attach ancestor keys and indices,
``flatten`` joins the arrays of each nesting level, and one ``inline`` per target table emits its rows. A level's nodes give up
their fields when they are reached, so no row carries a subtree.

Defined results: a null, empty, cut off or otherwise invalid payload, and one without a graph, give no rows. Of a payload's
objects with nodes or a root those nearest to its top are the graphs. A node without an id gives no node row, box, breadcrumb
or link, but its nested children still give theirs. Repeated nodes and links of one payload give one row. A missing or
unreadable optional field is null, and a box is emitted only if it has at least one readable coordinate. Other columns of
the input are ignored; the two keys are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.session import checkpointed

CRUMB_SEPARATOR = " > "


class FlatGraph:
    """The related tables, each made when it is first asked for; keys are (record, node id), links keep parent and child ids."""

    def __init__(self, nodes: Callable[[], DataFrame], boxes: Callable[[], DataFrame], breadcrumbs: Callable[[], DataFrame], links: Callable[[], DataFrame]) -> None:
        self._make = {"nodes": nodes, "boxes": boxes, "breadcrumbs": breadcrumbs, "links": links}

    @cached_property
    def nodes(self) -> DataFrame:
        return self._make["nodes"]()

    @cached_property
    def boxes(self) -> DataFrame:
        return self._make["boxes"]()

    @cached_property
    def breadcrumbs(self) -> DataFrame:
        return self._make["breadcrumbs"]()

    @cached_property
    def links(self) -> DataFrame:
        return self._make["links"]()


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def unwrapped(payload: Column) -> Column:
    """The JSON text itself where the payload is a JSON string that holds it, however often: k wraps begin with 2 ** k - 1 quotes and backslashes."""
    wraps = F.ceil(F.log2(F.length(F.regexp_extract(payload, r'^\s*(["\\]*)', 1)) + 1)).cast("int")
    inner = lambda p, _: F.when(F.ltrim(p).startswith('"'), _get(F.try_parse_json(p), "$", "string")).otherwise(p)
    return F.when(F.ltrim(payload).startswith('"'), F.aggregate(F.sequence(F.lit(1), wraps), payload, inner)).otherwise(payload)


def nesting(payload: Column) -> Column:
    """The deepest nesting of brackets outside the strings of a JSON text."""
    bare = F.regexp_replace(payload, r'"(?:[^"\\]++|\\.)*+"', "")
    depths = F.aggregate(
        F.regexp_extract_all(bare, F.lit(r"([\[{\]}])"), 1),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, b: F.struct(
            (s["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("now"),
            F.greatest(s["most"], s["now"] + 1).alias("most"),
        ),
    )
    return depths["most"]


def _node(v: Column, key: Column, parent: Column, lineage: Column) -> Column:
    return F.struct(
        v.alias("v"),
        F.coalesce(_get(v, "$.id", "string"), key).alias("id"),
        parent.alias("above"),
        lineage.alias("lineage"),
    )


def _level_below(level: Column) -> Column:
    """The children, given as objects, of a level's nodes, with their parent's id and the indices from the root on."""
    return F.flatten(
        F.transform(
            level,
            lambda n: F.transform(
                F.coalesce(_get(n["v"], "$.children", "array<variant>"), F.array().cast("array<variant>")),
                lambda c, i: _node(c, F.lit(None).cast("string"), n["id"], F.concat(n["lineage"], F.array(i.cast("int")))),
            ),
        )
    )


def _is_object(n: Column) -> Column:
    # child references are plain ids; they are links, not nodes
    return _get(n["v"], "$", "map<string,variant>").isNotNull()


_NOTHING = "array<struct<v:variant,id:string,above:string,lineage:array<int>>>"


def _graphs(v: Column, payload: Column) -> Column:
    """The objects nearest to the top that hold nodes or a root, with the text they were parsed from."""
    nothing = F.array().cast("array<struct<v:variant,text:string>>")
    is_graph = lambda x: _get(x["v"], "$.nodes", "variant").isNotNull() | _get(x["v"], "$.root", "variant").isNotNull()
    # a string that holds JSON is opened like an object
    opened = lambda t: F.when(F.ltrim(t).rlike(r'^[\[{"]'), F.filter(F.array(F.struct(F.try_parse_json(t).alias("v"), t.alias("text"))), lambda x: x["v"].isNotNull()))
    inside = lambda x: F.coalesce(
        F.transform(F.coalesce(F.map_values(_get(x["v"], "$", "map<string,variant>")), _get(x["v"], "$", "array<variant>")), lambda c: F.struct(c.alias("v"), x["text"].alias("text"))),
        opened(_get(x["v"], "$", "string")),
        nothing,
    )

    def step(s: Column, _: Column) -> Column:
        found = F.filter(s["level"], is_graph)
        go_on = F.struct(F.flatten(F.transform(s["level"], inside)).alias("level"), nothing.alias("found"))
        looked = F.when(F.size(found) > 0, F.struct(nothing.alias("level"), found.alias("found"))).otherwise(go_on)
        return F.when((F.size(s["found"]) > 0) | (F.size(s["level"]) == 0), s).otherwise(looked)

    # brackets inside strings count where a string may hold JSON
    steps = F.when(payload.rlike(r'[:\[,]\s*\\*"\s*[\[{]'), F.regexp_count(payload, F.lit(r"[\[{]"))).otherwise(nesting(payload)) + 1
    start = F.struct(F.array(F.struct(v.alias("v"), payload.alias("text"))).alias("level"), nothing.alias("found"))
    # most graphs lie at the top
    return F.when(is_graph(start["level"][0]), start["level"]).otherwise(F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["found"]))


def _top(graph: Column) -> Column:
    """The first nodes of a graph: listed, keyed, or the root."""
    no, nothing = F.lit(None).cast("string"), F.array().cast(_NOTHING)
    many, root = _get(graph, "$.nodes", "variant"), _get(graph, "$.root", "variant")
    return F.filter(
        F.concat(
            F.coalesce(F.transform(_get(many, "$", "array<variant>"), lambda n, i: _node(n, no, no, F.array(i.cast("int")))), nothing),
            F.coalesce(F.transform(F.map_entries(_get(many, "$", "map<string,variant>")), lambda e, i: _node(e["value"], e["key"], no, F.array(i.cast("int")))), nothing),
            F.coalesce(F.when(root.isNotNull(), F.array(_node(root, no, no, F.array(F.lit(0))))), nothing),
        ),
        _is_object,
    )


def _fields(n: Column, whole: bool) -> Column:
    """A node's own fields: for links its ids and those it names, for all tables the rest as well."""
    v = n["v"]
    kids = F.transform(_get(v, "$.children", "array<variant>"), lambda c: F.coalesce(_get(c, "$.id", "string"), _get(c, "$", "string")))
    own = [n["id"].alias("id"), n["above"].alias("above"), n["lineage"].alias("lineage"), _get(v, "$.parent", "string").alias("parent"), kids.alias("kids")]
    if not whole:
        return F.struct(*own)
    crumbs = "$.location.semantic.breadcrumbs"
    return F.struct(
        *own,
        _get(v, "$.node_type", "string").alias("node_type"),
        _get(v, "$.location.semantic.path", "string").alias("path"),
        _get(v, "$.location.semantic.depth", "int").alias("depth"),
        _get(v, "$.location.physical.page", "int").alias("page"),
        _get(v, "$.text_order", "int").alias("text_order"),
        _get(v, "$.content.text", "string").alias("text"),
        _get(v, "$.token_count", "bigint").alias("token_count"),
        _box(v, "$.location.physical.bounding_box").alias("box"),
        # crumbs given as one string are split at the separator
        F.coalesce(_get(v, crumbs, "array<string>"), F.split(_get(v, crumbs, "string"), CRUMB_SEPARATOR)).alias("crumbs"),
    )


def graph_nodes(records: DataFrame, record: str = "record_id", doc: str = "doc_id", payload: str = "payload", whole: bool = True) -> DataFrame:
    """One row per node of every complete payload: keys, id, nested parent, indices from the root and the fields (see ``_fields``).

    A fold over the tree levels of each payload, as many as its own brackets allow, so that any depth is followed.
    """
    keys = ["record", "doc"]
    base = records.select(F.col(record).alias("record"), F.col(doc).alias("doc"), unwrapped(F.col(payload).cast("string")).alias("payload"))
    v = base.select(*keys, "payload", F.try_parse_json("payload").alias("v")).filter("v is not null")
    graphs = v.select(*keys, _graphs(F.col("v"), F.col("payload")).alias("graphs")).filter("size(graphs) > 0")
    # a tree level takes an object and an array
    depth = F.array_max(F.transform("graphs", lambda g: nesting(g["text"])))
    seeds = graphs.select(*keys, (F.floor(depth / 2) + 1).cast("int").alias("levels"), F.flatten(F.transform("graphs", lambda g: _top(g["v"]))).alias("top"))
    nothing = F.array().cast(_NOTHING)
    fields = lambda level: F.transform(level, lambda n: _fields(n, whole))

    def step(s: Column, _: Column) -> Column:
        # the one-element array binds the new level, so that it is computed once
        below = F.transform(F.array(F.filter(_level_below(s["level"]), _is_object)), lambda b: F.struct(b.alias("level"), F.when(F.size(b) > 0, F.concat(s["every"], fields(b))).otherwise(s["every"]).alias("every")))
        return F.when(F.size(s["level"]) > 0, F.element_at(below, 1)).otherwise(F.struct(nothing.alias("level"), s["every"].alias("every")))

    start = F.struct(F.col("top").alias("level"), fields(F.col("top")).alias("every"))
    tree = F.aggregate(F.sequence(F.lit(1), F.col("levels")), start, step, lambda s: s["every"])
    # the outer form, as before the other one the optimizer computes the fold once more to filter by its size
    return seeds.select(*keys, F.inline_outer(tree)).filter("lineage is not null")


def stated_links(nodes: DataFrame) -> DataFrame:
    """Distinct (record, doc, parent_id, child_id) that the payload states by nesting, ``parent`` or ``children``, both ids being its nodes.

    One shuffle, on the record: node rows and link rows travel together and two windows, both inside a record, tell
    which ids are known.
    """
    row = lambda p, c, known: F.struct(p.alias("p"), c.alias("c"), F.lit(known).alias("is_node"))
    inner = F.transform(F.coalesce("kids", F.array().cast("array<string>")), lambda c: row(F.col("id"), c, 0))
    own = F.array(row(F.lit(None).cast("string"), F.col("id"), 1), row(F.col("parent"), F.col("id"), 0), row(F.col("above"), F.col("id"), 0))
    rows = nodes.select("record", "doc", F.inline_outer(F.concat(own, inner))).filter("c is not null and (is_node = 1 or p is not null)")
    rows = rows.repartition("record")
    child = Window.partitionBy("record", "c")
    parent = Window.partitionBy("record", "k")
    return (
        rows.withColumn("child_known", F.max("is_node").over(child))
        .withColumn("k", F.when(F.col("is_node") == 1, F.col("c")).otherwise(F.col("p")))
        .withColumn("parent_known", F.max("is_node").over(parent))
        .filter("is_node = 0 and child_known = 1 and parent_known = 1")
        .select("record", "doc", F.col("p").alias("parent_id"), F.col("c").alias("child_id"))
        .distinct()
    )


def _box(v: Column, path: str) -> Column:
    """The four numbers of a box given as an object, an array or a comma-separated string."""
    pairs = F.coalesce(
        _get(v, path, "array<double>"),
        F.transform(F.split(_get(v, path, "string"), ","), lambda s: s.try_cast("double")),
    )
    names = ("x", "y", "width", "height")
    return F.struct(
        *[
            F.coalesce(_get(v, f"{path}.{n}", "double"), F.get(pairs, F.lit(i))).cast("float").alias(n)
            for i, n in enumerate(names)
        ]
    )


def flatten_graphs(records: DataFrame, record: str = "record_id", doc: str = "doc_id", payload: str = "payload") -> FlatGraph:
    """Nodes, boxes, breadcrumbs and links of every complete payload (see the module for the defined cases).

    The payloads are parsed once for nodes, boxes and breadcrumbs, and, with fewer fields, once for the links.
    """
    made: list[DataFrame] = []

    def known() -> DataFrame:
        if not made:
            made.append(checkpointed(graph_nodes(records, record, doc, payload)).filter("id is not null"))
        return made[0]

    keys = [F.col("record").alias(record), F.col("doc").alias(doc), F.col("id").alias("node_id")]
    place = lambda c, i: F.struct(i.cast("int").alias("position"), c.alias("crumb"))
    return FlatGraph(
        lambda: known().select(*keys, "node_type", "path", "depth", "page", "text_order", "text", "token_count").distinct(),
        lambda: known().select(*keys, "page", F.inline(F.array("box"))).filter("coalesce(x, y, width, height) is not null").distinct(),
        lambda: known().select(*keys, F.inline(F.transform("crumbs", place))).distinct(),
        lambda: stated_links(graph_nodes(records, record, doc, payload, whole=False)).select(F.col("record").alias(record), F.col("doc").alias(doc), "parent_id", "child_id"),
    )


def flatten_node_structs(nodes: DataFrame) -> FlatGraph:
    """The same tables from the nested structs of the ``nodes`` table (keys doc_id and id; repeated rows give one row).

    A row without an id gives nothing. Links are those stated by ``children`` or ``parent`` between two ids of the
    document.
    """
    known = nodes.filter("id is not null")
    keys = ["doc_id", F.col("id").alias("node_id")]
    flat = known.select(
        *keys,
        "node_type",
        F.col("location.semantic.path").alias("path"),
        F.col("location.semantic.depth").alias("depth"),
        F.col("location.physical.page").alias("page"),
        "text_order",
        F.col("content.text").alias("text"),
        "token_count",
    ).distinct()
    boxes = known.filter("location.physical.bounding_box is not null").select(
        *keys, F.col("location.physical.page").alias("page"), "location.physical.bounding_box.*"
    ).distinct()
    crumbs = known.select(
        *keys,
        F.inline(F.transform("location.semantic.breadcrumbs", lambda c, i: F.struct(i.cast("int").alias("position"), c.alias("crumb")))),
    ).distinct()
    # ids are unique across documents, so that known ids are found by two windows on the id alone
    own = F.array(
        F.struct(F.lit(None).cast("string").alias("p"), F.col("id").alias("c"), F.lit(1).alias("is_node")),
        F.struct(F.col("parent").alias("p"), F.col("id").alias("c"), F.lit(0).alias("is_node")),
    )
    stated = F.transform(
        F.coalesce("children", F.array().cast("array<string>")),
        lambda c: F.struct(F.col("id").alias("p"), c.alias("c"), F.lit(0).alias("is_node")),
    )
    rows = known.select("doc_id", F.inline(F.concat(own, stated))).filter("c is not null and (is_node = 1 or p is not null)").distinct()
    links = (
        rows.withColumn("child_known", F.max("is_node").over(Window.partitionBy("doc_id", "c")))
        .withColumn("k", F.when(F.col("is_node") == 1, F.col("c")).otherwise(F.col("p")))
        .withColumn("parent_known", F.max("is_node").over(Window.partitionBy("doc_id", "k")))
        .filter("is_node = 0 and child_known = 1 and parent_known = 1")
        .select("doc_id", F.col("p").alias("parent_id"), F.col("c").alias("child_id"))
    )
    return FlatGraph(lambda: flat, lambda: boxes, lambda: crumbs, lambda: links)

"""Navigation and rendering over the node table (flat form: see ``profile.flat_nodes``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators.profile import subtree_nodes


class NodeNotFound(KeyError):
    """No node has the id asked for."""


def of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == node_type)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent is null")


def get_node(nodes: DataFrame, doc_id: int, node_id: str):
    """The row of one node; raises NodeNotFound."""
    row = nodes.filter((F.col("doc_id") == doc_id) & (F.col("id") == node_id)).first()
    if row is None:
        raise NodeNotFound(node_id)
    return row


def on_page(nodes: DataFrame, page: int) -> DataFrame:
    return nodes.filter(F.col("location.physical.page") == page)


def parents(nodes: DataFrame) -> DataFrame:
    """doc_id, id, parent_id, parent_type; null for roots and for parents that aren't nodes."""
    p = nodes.select("doc_id", F.col("id").alias("parent"), F.col("node_type").alias("parent_type"), F.col("id").alias("parent_id"))
    return nodes.select("doc_id", "id", "parent").join(p, ["doc_id", "parent"], "left").select("doc_id", "id", "parent_id", "parent_type")


def children(nodes: DataFrame) -> DataFrame:
    """doc_id, id, position, child_id in the order of ``children``; ids that aren't nodes are left out."""
    listed = nodes.select("doc_id", "id", F.posexplode("children").alias("position", "child_id"))
    return listed.join(nodes.select("doc_id", F.col("id").alias("child_id")), ["doc_id", "child_id"], "left_semi").select("doc_id", "id", "position", "child_id")


def render(nodes: DataFrame, flat: DataFrame, tops: DataFrame, breadcrumbs: bool = False, node_types: bool = False) -> DataFrame:
    """doc_id, top, text: one part a node of each subtree, in preorder, parted by blank lines; empty parts are left out.

    A part is the node's text, with its type before it (``node_types``), or for sections and roots their breadcrumbs in
    place of the text (``breadcrumbs``).
    """
    trail = F.coalesce(F.array_join("location.semantic.breadcrumbs", " > "), F.lit(""))
    rows = subtree_nodes(flat, tops).join(nodes.dropDuplicates(["doc_id", "id"]).select("doc_id", "id", trail.alias("trail")), ["doc_id", "id"])
    kind, text = F.col("node_type"), F.coalesce("text", F.lit(""))
    part = F.concat(F.lit("["), kind, F.lit("] "), text) if node_types else text
    if breadcrumbs:
        named = F.concat(F.lit("["), kind, F.lit(" | "), "trail", F.lit("]")) if node_types else F.concat(F.lit("["), "trail", F.lit("]"))
        part = F.when(kind.isin("Section", "Document"), named).otherwise(part)
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("text_order", F.lit(-1)).alias("o"), part.alias("t"))))
    return rows.groupBy("doc_id", "top").agg(F.array_join(F.filter(F.transform(ordered, lambda s: s["t"]), lambda t: t != ""), "\n\n").alias("text"))

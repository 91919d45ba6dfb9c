"""Queries of the nested-record operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioloom.operators.nested import flatten_graphs, flatten_node_structs
from folioloom.sources.tables import table


def _graphs(spark: SparkSession, d: str):
    return flatten_graphs(table(spark, d, "graph_records"))


def _structs(spark: SparkSession, d: str):
    return flatten_node_structs(table(spark, d, "nodes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _graphs(spark, d).links.select("doc_id", "parent_id", "child_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_payload_nodes": lambda s, d: _graphs(s, d).nodes,
    "p1_payload_boxes": lambda s, d: _graphs(s, d).boxes,
    "p1_payload_breadcrumbs": lambda s, d: _graphs(s, d).breadcrumbs,
    "p1_payload_links": lambda s, d: _graphs(s, d).links,
    "p1_struct_nodes": lambda s, d: _structs(s, d).nodes,
    "p1_struct_boxes": lambda s, d: _structs(s, d).boxes,
    "p1_struct_breadcrumbs": lambda s, d: _structs(s, d).breadcrumbs,
    "p1_struct_links": lambda s, d: _structs(s, d).links,
}

_TREE = """
WITH whole AS (
  SELECT record_id, doc_id,
         CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END AS body
  FROM graph_records WHERE json_valid(payload)),
tree AS (
  SELECT w.record_id, w.doc_id, j.key, j.value
  FROM (SELECT * FROM whole WHERE json_valid(body)) w, json_tree(w.body) j
  WHERE j.type = 'OBJECT' AND json_exists(j.value, '$.node_type')),
n AS (
  SELECT record_id, doc_id, value, coalesce(value->>'$.id', CAST(key AS VARCHAR)) AS id FROM tree)
"""

_LINKS = _TREE + """,
kids AS (SELECT record_id, doc_id, id, unnest(json_extract(value, '$.children[*]')) AS kid FROM n),
stated AS (
  SELECT record_id, doc_id, value->>'$.parent' AS parent_id, id AS child_id FROM n
  UNION
  SELECT record_id, doc_id, id, CASE WHEN json_type(kid) = 'OBJECT' THEN kid->>'$.id' ELSE kid->>'$' END FROM kids),
links AS (
  SELECT DISTINCT s.record_id, s.doc_id, s.parent_id, s.child_id FROM stated s
  JOIN n p ON p.record_id = s.record_id AND p.id = s.parent_id
  JOIN n c ON c.record_id = s.record_id AND c.id = s.child_id)
"""

_BOX = "value->'$.location.physical.bounding_box'"


def _side(name: str, i: int) -> str:
    return f"""TRY_CAST(CASE json_type({_BOX}) WHEN 'OBJECT' THEN {_BOX}->>'$.{name}' WHEN 'ARRAY' THEN {_BOX}->>'$[{i}]'
               WHEN 'VARCHAR' THEN string_split({_BOX}->>'$', ',')[{i + 1}] END AS FLOAT) AS {name}"""


_STRUCT_LINKS = """
WITH n AS (SELECT DISTINCT doc_id, id, parent, children FROM nodes WHERE id IS NOT NULL),
stated AS (
  SELECT doc_id, parent AS parent_id, id AS child_id FROM n
  UNION
  SELECT doc_id, id, unnest(children) FROM n)
SELECT DISTINCT s.doc_id, s.parent_id, s.child_id FROM stated s
WHERE EXISTS (SELECT 1 FROM n WHERE n.doc_id = s.doc_id AND n.id = s.parent_id)
  AND EXISTS (SELECT 1 FROM n WHERE n.doc_id = s.doc_id AND n.id = s.child_id)
"""

SQL = {
    "p1_found": _LINKS + "SELECT DISTINCT doc_id, parent_id, child_id FROM links",
    "p1_payload_links": _LINKS + "SELECT record_id, doc_id, parent_id, child_id FROM links",
    "p1_payload_nodes": _TREE + """
SELECT DISTINCT record_id, doc_id, id AS node_id, value->>'$.node_type' AS node_type,
       value->>'$.location.semantic.path' AS path, TRY_CAST(value->>'$.location.semantic.depth' AS INTEGER) AS depth,
       TRY_CAST(value->>'$.location.physical.page' AS INTEGER) AS page, TRY_CAST(value->>'$.text_order' AS INTEGER) AS text_order,
       value->>'$.content.text' AS text, TRY_CAST(value->>'$.token_count' AS BIGINT) AS token_count FROM n""",
    "p1_payload_boxes": _TREE + f"""
SELECT DISTINCT * FROM (
  SELECT record_id, doc_id, id AS node_id, TRY_CAST(value->>'$.location.physical.page' AS INTEGER) AS page,
         {", ".join(_side(x, i) for i, x in enumerate(("x", "y", "width", "height")))} FROM n)
WHERE coalesce(x, y, width, height) IS NOT NULL""",
    "p1_payload_breadcrumbs": _TREE + """,
b AS (
  SELECT record_id, doc_id, id, CASE json_type(value->'$.location.semantic.breadcrumbs')
           WHEN 'ARRAY' THEN value->>'$.location.semantic.breadcrumbs[*]'
           WHEN 'VARCHAR' THEN string_split(value->>'$.location.semantic.breadcrumbs', ' > ') END AS crumbs FROM n)
SELECT DISTINCT record_id, doc_id, id AS node_id, CAST(i - 1 AS INTEGER) AS position, crumbs[i] AS crumb
FROM (SELECT *, unnest(range(1, len(crumbs) + 1)) AS i FROM b)""",
    "p1_struct_nodes": """
SELECT DISTINCT doc_id, id AS node_id, node_type, location.semantic.path AS path, location.semantic.depth AS depth,
       location.physical.page AS page, text_order, content.text AS text, token_count FROM nodes WHERE id IS NOT NULL""",
    "p1_struct_boxes": """
SELECT DISTINCT doc_id, id AS node_id, location.physical.page AS page, location.physical.bounding_box.x AS x,
       location.physical.bounding_box.y AS y, location.physical.bounding_box.width AS width,
       location.physical.bounding_box.height AS height
FROM nodes WHERE id IS NOT NULL AND location.physical.bounding_box IS NOT NULL""",
    "p1_struct_breadcrumbs": """
SELECT DISTINCT doc_id, id AS node_id, CAST(i - 1 AS INTEGER) AS position, crumbs[i] AS crumb
FROM (SELECT doc_id, id, location.semantic.breadcrumbs AS crumbs, unnest(range(1, len(location.semantic.breadcrumbs) + 1)) AS i
      FROM nodes WHERE id IS NOT NULL)""",
    "p1_struct_links": _STRUCT_LINKS,
}

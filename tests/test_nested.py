"""Nested payloads: layouts, wrappers, defects, depth."""

import json

from folioloom.operators.nested import flatten_graphs, flatten_node_structs

PAYLOAD = "record_id bigint, doc_id bigint, payload string"


def links(spark, *payloads):
    df = spark.createDataFrame([(i, 1, p) for i, p in enumerate(payloads)], PAYLOAD)
    return sorted((r.record_id, r.parent_id, r.child_id) for r in flatten_graphs(df).links.collect())


def test_layouts_and_wrappers_state_the_same_links(spark):
    listed = {"nodes": [{"id": "r", "children": ["a", "a", "gone"]}, {"id": "a"}, {"id": "b", "parent": "r"}]}
    keyed = {"graph": {"nodes": {"r": {"children": ["a"]}, "a": {}, "b": {"parent": "r"}}}}
    nested = {"data": {"result": {"root": {"id": "r", "children": [{"id": "a"}, {"id": "b", "children": None}]}}}}
    texts = [json.dumps(listed), json.dumps(keyed), json.dumps(nested), json.dumps(json.dumps(listed))]
    assert links(spark, *texts) == [(i, "r", c) for i in range(4) for c in "ab"]


def test_graphs_are_found_anywhere(spark):
    listed = {"nodes": [{"id": "r", "children": ["a"]}, {"id": "a"}]}
    tree = {"root": {"id": "r", "children": [{"id": "a", "children": [{"id": "b", "children": [{"id": "c"}]}]}]}}
    wrapped = json.dumps(listed)
    for _ in range(4):
        wrapped = json.dumps(wrapped)
    texts = [
        json.dumps({"response": {"graph": listed}}), json.dumps([{"x": 1}, {"any": [{"deep": listed}]}]), wrapped,
        json.dumps({"meta": "]]}}", "body": json.dumps({"inner": json.dumps(listed)})}), json.dumps({"graph": listed, "other": {"deep": {"nodes": [{"id": "q", "parent": "q"}]}}}),
    ]
    assert links(spark, *texts) == [(i, "r", "a") for i in range(5)]
    assert links(spark, json.dumps({"payload": json.dumps(tree)})) == [(0, "a", "b"), (0, "b", "c"), (0, "r", "a")]


def test_incomplete_null_and_foreign_payloads_state_nothing(spark):
    assert links(spark, '{"nodes":[{"id":"r","children":["a"]},{"id":"a"}', None, "", "[]", "1", '{"other":1}', '{"nodes":null}') == []


def test_any_depth_is_followed(spark):
    tree = {"id": "n0"}
    at = tree
    for k in range(1, 40):
        at["children"] = [{"id": f"n{k}"}]
        at = at["children"][0]
    assert len(links(spark, json.dumps({"root": tree}))) == 39


def test_brackets_in_strings_and_missing_ids(spark):
    p = json.dumps({"root": {"id": "r", "content": {"text": '[[{{"\\\\'}, "children": [{"children": [{"id": "x"}]}, {"id": "y"}]}})
    assert links(spark, p) == [(0, "r", "y")]


def test_boxes_and_breadcrumbs_in_every_form(spark):
    loc = lambda b, c, p: {"semantic": {"breadcrumbs": c}, "physical": {"page": p, "bounding_box": b}}
    nodes = [
        {"id": "a", "location": loc({"x": 1, "y": 2, "width": 3, "height": 4}, ["t", "u"], 2)},
        {"id": "b", "location": loc([1, 2, 3, 4], "t > u", "2")},
        {"id": "c", "location": loc("1.0,2.0,3.0,4.0", None, "x")},
        {"id": "d", "location": {"physical": None}},
        {"id": "e"},
    ]
    g = flatten_graphs(spark.createDataFrame([(1, 1, json.dumps({"nodes": nodes}))], PAYLOAD))
    assert sorted((r.node_id, r.page, r.x, r.height) for r in g.boxes.collect()) == [("a", 2, 1.0, 4.0), ("b", 2, 1.0, 4.0), ("c", None, 1.0, 4.0)]
    assert sorted((r.node_id, r.position, r.crumb) for r in g.breadcrumbs.collect()) == [("a", 0, "t"), ("a", 1, "u"), ("b", 0, "t"), ("b", 1, "u")]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], PAYLOAD + ", parent_id string, id string, v int")
    g = flatten_graphs(df)
    assert [t.count() for t in (g.nodes, g.boxes, g.breadcrumbs, g.links)] == [0, 0, 0, 0]


def test_structs(spark):
    ddl = "doc_id bigint, id string, node_type string, location struct<semantic:struct<path:string,depth:int,breadcrumbs:array<string>>,physical:struct<page:int,bounding_box:struct<x:float,y:float,width:float,height:float>>>, text_order int, content struct<text:string>, token_count bigint, parent string, children array<string>"
    row = (1, "r", "Document", (("", 0, ["t"]), None), None, ("x",), 0, None, ["a", "gone", "a"])
    kid = (1, "a", "Paragraph", (("1", 1, None), (1, (1.0, 2.0, 3.0, 4.0))), 0, (None,), None, "r", None)
    g = flatten_node_structs(spark.createDataFrame([row, row, kid, (1, None, "x", None, None, None, None, "r", None)], ddl))
    assert g.nodes.count() == 2 and g.boxes.count() == 1 and g.breadcrumbs.count() == 1
    assert [(r.parent_id, r.child_id) for r in g.links.collect()] == [("r", "a")]

"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import encoding, lookalikes, mixing, packing, scans, splitting
from folioloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.pairs(table(spark, d, "nodes"), table(spark, d, "document_metadata"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal-looking texts as membership: one row a text, whatever the number of its pairs."""
    return lookalikes.memberships(table(spark, d, "nodes"), table(spark, d, "document_metadata"))


def p2_node_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every node's text in its canonical form."""
    nodes = table(spark, d, "nodes").select("doc_id", F.col("id").alias("node_id"), F.col("content.text").alias("text"))
    return lookalikes.canonical_texts(nodes, ["doc_id", "node_id"]).drop("text").distinct()


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every title in its canonical form."""
    return lookalikes.canonical_texts(table(spark, d, "document_metadata"), ["root_id"], "title").drop("text").distinct()


def p2_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The token spellings of node texts that change, and their canonical ones."""
    return lookalikes.spellings(table(spark, d, "nodes").select(F.col("content.text").alias("text")))


def _scans(spark: SparkSession, d: str) -> scans.Scans:
    return scans.Scans(table(spark, d, "nodes"), table(spark, d, "document_metadata"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).defects()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The running text of scanned documents' nodes, repaired."""
    return _scans(spark, d).repaired()


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Misread forms and what they are misreads of."""
    return _scans(spark, d).forms


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_nodes(table(spark, d, "nodes"), table(spark, d, "document_metadata"), table(spark, d, "size_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the splitter had to cut."""
    return p4_pieces(spark, d).filter("n_pieces > 1").select("node_id").distinct()


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p5_packed(spark, d), table(spark, d, "pack_sizes"))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing: all texts are packed whole and no container is overfull."""
    packs = table(spark, d, "pack_sizes").filter("capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    packed = p5_packed(spark, d)
    loads = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("load")).join(F.broadcast(packs), "pack_name")
    overfull = loads.groupBy("pack_name").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    whole = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size")).join(F.broadcast(packs), "pack_name")
    split = whole.groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("needlessly_split"))
    return split.join(overfull, "pack_name")


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every mixture: no record is used too often, and none of a source without a target."""
    goals = table(spark, d, "mix_targets").filter("source is not null").groupBy("source").agg(F.max("max_repeats").alias("most"))
    uses = p6_mixture(spark, d).groupBy("source", "doc_id").agg(F.count("*").alias("uses"))
    by_source = uses.groupBy("source").agg(F.max("uses").alias("used"))
    found = goals.join(by_source, "source", "full").withColumn("asked", F.col("most").isNotNull())
    return found.select("source", "asked", (F.coalesce("used", F.lit(0)) > F.coalesce("most", F.lit(0))).alias("too_often"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every affected document with its restored text."""
    return encoding.affected(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_repaired(spark, d).select("doc_id").distinct()


QUERIES = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_node_texts": p2_node_texts,
    "p2_titles": p2_titles,
    "p2_spellings": p2_spellings,
    "p7_found": p7_found,
    "p7_repaired": p7_repaired,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_packed": p5_packed,
    "p5_report": p5_report,
    "p5_invariants": p5_invariants,
    "p6_mixture": p6_mixture,
    "p6_shares": p6_shares,
    "p6_invariants": p6_invariants,
}



def _text_literal(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _look(text: str) -> str:
    """The look of a text in SQL: ignorables out, blanks and look-alikes by table, composed."""
    table_ = lookalikes.classes()
    single = {k: v for k, v in table_.items() if len(v) == 1} | {b: " " for b in lookalikes.BLANK}
    out = f"regexp_replace({text}, '[{lookalikes.IGNORABLE}]', '', 'g')"
    for k, v in table_.items():
        if len(v) > 1 and 0xFB00 <= ord(k) <= 0xFB06:
            out = f"replace({out}, '{k}', '{v}')"
    return f"nfc_normalize(translate({out}, {_text_literal(''.join(single))}, {_text_literal(''.join(single.values()))}))"


SQL = {
    "p2_found": f"""
WITH t AS (SELECT DISTINCT doc_id, id, content.text AS own, {_look("content.text")} AS look FROM nodes WHERE id IS NOT NULL AND content.text IS NOT NULL),
m AS (SELECT DISTINCT root_id AS id, title AS own, {_look("title")} AS look FROM document_metadata WHERE root_id IS NOT NULL AND title IS NOT NULL)
SELECT DISTINCT 'text' AS field, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.look = b.look AND a.id < b.id AND a.own <> b.own
UNION ALL
SELECT DISTINCT 'title', a.id, b.id FROM m a JOIN m b ON a.look = b.look AND a.id < b.id AND a.own <> b.own""",
    "p2_classes": f"""
WITH t AS (SELECT DISTINCT 'text' AS field, doc_id, id, content.text AS own, {_look("content.text")} AS look FROM nodes WHERE id IS NOT NULL AND content.text IS NOT NULL
  UNION SELECT 'title', NULL, root_id, title, {_look("title")} FROM document_metadata WHERE root_id IS NOT NULL AND title IS NOT NULL)
SELECT DISTINCT t.field, t.id, c.class_id, upper(sha256(t.own)) AS spelling FROM t
JOIN (SELECT field, doc_id, look, min(id) AS class_id FROM t GROUP BY ALL HAVING count(DISTINCT own) > 1) c ON c.field = t.field AND c.doc_id IS NOT DISTINCT FROM t.doc_id AND c.look = t.look""",
    "p5_invariants": """
SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS needlessly_split, CAST(0 AS BIGINT) AS overfull
FROM (SELECT DISTINCT pack_name FROM pack_sizes WHERE capacity_tokens > 0)""",
    "p6_invariants": "SELECT DISTINCT source, true AS asked, false AS too_often FROM mix_targets WHERE source IS NOT NULL",
    "p4_found": """
SELECT DISTINCT n.id AS node_id
FROM nodes n JOIN document_metadata m ON m.doc_id = n.doc_id
JOIN size_limits s ON s.document_type = m.document_type AND s.node_type = n.node_type
WHERE strlen(n.content.text) // 4 > s.max_tokens""",
}

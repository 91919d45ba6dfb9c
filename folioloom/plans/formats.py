"""Output shapes of document graphs, hashes, and the result cache."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.operators import profile
from folioloom.session import checkpointed

SCHEMA_VERSION = "0.2.0"
METADATA = (
    "title", "author", "language", "page_count", "publisher", "creator_tool", "producer", "pdf_version", "created", "modified", "description", "encrypted", "has_marked_content",
)


def without_style(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("style_info", F.lit(None).cast(nodes.schema["style_info"].dataType))


def _in_order(row: Column) -> Column:
    # roots have no text order and come first
    return F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("text_order", F.lit(-1)).alias("o"), F.col("id").alias("i"), row.alias("r")))), lambda s: s["r"])


def _json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def _profiles(nodes: DataFrame, created_at: Column | None) -> DataFrame:
    narrow = profile.flat_nodes(nodes).select("doc_id", "node_type", "depth", "token_count")
    return profile.structural(checkpointed(narrow), created_at)


def metadata(table: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id and the data model's metadata fields, one row a document. ``titles`` (doc_id, title) are the merged ones."""
    out = table.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", *METADATA)
    if titles is not None:
        out = titles.select("doc_id", "title").join(out.drop("title"), "doc_id", "left").select("doc_id", *METADATA)
    return out.withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def graph(nodes: DataFrame, info: DataFrame | None = None, analysis: DataFrame | None = None, created_at: Column | None = None) -> DataFrame:
    """doc_id, json: schema version, sorted nodes, document info and structural profile.

    ``info`` is ``metadata()``'s, ``analysis`` ``typography.document_analysis()``'s; what is not given is null, as is a
    document's that is not in it. Null fields are kept, a null style is left out.
    """
    fields = ["id", "node_type", "location", "text_order", "content", "token_count", "parent", "children"]
    # the style is spliced in where it is there
    node = F.when(F.col("style_info").isNull(), _json(F.struct(*fields))).otherwise(_json(F.struct(*fields, "style_info")))
    docs = nodes.groupBy("doc_id").agg(F.array_join(_in_order(node), ",").alias("nodes"), F.max(F.when(F.col("parent").isNull(), F.col("id"))).alias("root_id"))
    null = F.lit(None).cast("string")
    docs = docs.join(info.select("doc_id", _json(F.struct(*[c for c in info.columns if c != "doc_id"])).alias("info")), "doc_id", "left") if info is not None else docs.withColumn("info", null)
    if analysis is not None:
        docs = docs.join(analysis.withColumn("_found", F.lit(True)), "doc_id", "left")
        analysed = F.struct(
            "font_size_counts", "font_family_counts", F.array("bold", "not_bold").alias("bold_counts"), F.array("italic", "not_italic").alias("italic_counts"), "most_common_font_size",
            "most_common_font_family", F.flatten(F.transform("all_font_sizes", lambda r: F.array_repeat(r["font_size"], r["n"].cast("int")))).alias("all_font_sizes"),
        )
        docs = docs.withColumn("analysis", F.when(F.col("_found"), _json(analysed)))
    else:
        docs = docs.withColumn("analysis", null)
    docs = docs.join(_profiles(nodes, created_at).select("doc_id", _json(F.col("structural_profile")).alias("profile")), "doc_id", "left")
    part = lambda c: F.coalesce(c, F.lit("null"))
    return docs.select(
        "doc_id",
        F.concat(
            F.lit(f'{{"schema_version":"{SCHEMA_VERSION}","document_info":{{"root_id":"'), F.coalesce("root_id", F.lit("")), F.lit('","document_metadata":'), part("info"),
            F.lit(',"document_analysis":'), part("analysis"), F.lit('},"nodes":['), F.col("nodes"), F.lit('],"structural_profile":'), part("profile"), F.lit("}"),
        ).alias("json"),
    )


def sequential(nodes: DataFrame) -> DataFrame:
    """doc_id, segment (0 is the root), node_type, text, location, style, tokens."""
    segment = F.coalesce(F.col("text_order") + 1, F.lit(0))
    return nodes.select("doc_id", segment.alias("segment"), "node_type", F.col("content.text").alias("text"), "location", F.col("style_info").alias("style"), F.col("token_count").alias("tokens"))


def sequential_documents(nodes: DataFrame, created_at: Column | None = None) -> DataFrame:
    """doc_id, format, segments (in order, their ids counted from 0), structural_profile."""
    names = ("node_type", "text", "location", "style", "tokens")
    row = F.struct("node_type", F.col("content.text").alias("text"), "location", F.col("style_info").alias("style"), F.col("token_count").alias("tokens"))
    docs = nodes.groupBy("doc_id").agg(F.transform(_in_order(row), lambda r, k: F.struct(k.cast("bigint").alias("id"), *[r[c].alias(c) for c in names])).alias("segments"))
    return docs.join(_profiles(nodes, created_at), "doc_id", "left").select("doc_id", F.lit("sequential").alias("format"), "segments", "structural_profile")


def flat(nodes: DataFrame) -> DataFrame:
    """doc_id, chunks: the texts in order, the root's first."""
    return nodes.groupBy("doc_id").agg(_in_order(F.col("content.text")).alias("chunks"))


def formatted(nodes: DataFrame, name: str, info: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """``sequential``, ``flat``, or for any other name the graph."""
    return {"sequential": sequential_documents, "flat": flat}.get(name, lambda n: graph(n, info, analysis))(nodes)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def partial_hash(content: bytes) -> str:
    """Of a file: its length and its first and last KB."""
    h = hashlib.sha256(struct.pack("<Q", len(content)))
    h.update(content[:1024])
    if len(content) > 1024:
        h.update(content[-1024:])
    return h.hexdigest()


def cache_key(content_hash: Column, config_hash: str, version: str = SCHEMA_VERSION) -> Column:
    return F.sha2(F.concat_ws("|", content_hash, F.lit(config_hash), F.lit(version)), 256)


def uncached(inputs: DataFrame, cache: DataFrame, key: str = "cache_hash") -> DataFrame:
    """The inputs without a cached result; known ones are skipped by an anti join."""
    return inputs.join(cache.select(key).distinct(), key, "left_anti")


def store(results: DataFrame, path: str) -> None:
    """Adds results to the cache table at ``path``."""
    results.write.mode("append").parquet(path)

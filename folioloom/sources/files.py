"""File sources: raw documents, markup, and graphs as JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators.nested import FlatGraph, flatten_graphs

#: Backends that turn a document's bytes into markup, by name; register callables bytes -> str.
BACKENDS: dict[str, Callable[[bytes], str]] = {}


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content, of PDF files in any spelling of the extension."""
    return spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".pdf")).select(F.col("path").alias("doc_id"), "content")


def markup_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), xhtml."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xhtml"))


def to_markup(raw: DataFrame, backend: str) -> DataFrame:
    """Runs a registered backend over Arrow batches of documents; a document that fails has a null markup and its error."""
    run = BACKENDS[backend]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, content in zip(b["doc_id"], b["content"]):
                try:
                    out.append((doc, run(bytes(content)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((doc, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "xhtml", "error"])

    return raw.select("doc_id", "content").mapInPandas(work, "doc_id string, xhtml string, error string")


def graph_files(spark: SparkSession, path: str) -> FlatGraph:
    """Graph JSON files, one graph a file, as related tables."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.xxhash64("_metadata.file_path").alias("record_id"), F.col("value").alias("payload"))
    return flatten_graphs(files)

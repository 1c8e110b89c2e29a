"""Incremental maintenance: appending missing documents and moving ids, in batches or from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quill.functions import text as T
from quill.operators.segmenting import numbered


def missing(docs: DataFrame, indexed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a text that the index doesn't have."""
    return docs.filter(T.strip(text) != "").join(indexed.select(key).distinct(), key, "left_anti")


def appended(new_chunks: DataFrame, total: int, key: str = "doc_id") -> DataFrame:
    """New chunks with ids that go on at ``total``."""
    return numbered(new_chunks, key, total)


def migrated(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(old_id, chunk_id, chunk_uid): ordinal ids of chunks that had others."""
    return numbered(chunks.select(key, "posicion", F.col("chunk_id").alias("old_id")), key).select("old_id", "chunk_id", "chunk_uid")


def append_stream(docs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``handle`` on each micro-batch of a stream of documents; with the left-anti join of ``missing`` in it a batch
    that is run again after a failure appends nothing twice."""
    return docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

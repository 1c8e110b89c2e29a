"""Token ids of whole corpora by a public byte-level BPE vocabulary.

Method: quill.llm.bpe (prefix-sharing trie walk over distinct words). Defined results: null and empty texts have an
empty list of ids and size 0; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from quill.llm.bpe import encoder, vocabulary_path

#: Texts handed to the encoder at once.
STEP = 2000


def shipped(spark: SparkSession, path: str):
    """Sends the vocabulary file to all machines; the function gives the encoder there."""
    name = os.path.basename(path)
    if not any(f.rpartition("/")[2] == name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return lambda: encoder(SparkFiles.get(name))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>): one row for each row of df."""
    own_encoder, kind = shipped(df.sparkSession, vocabulary_path(folder)), df.schema[key].dataType.simpleString()

    def run(batches):
        own = own_encoder()
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                offsets, ids = own.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))], ["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, size bigint): tokens of each text."""
    own_encoder, kind = shipped(df.sparkSession, vocabulary_path(folder)), df.schema[key].dataType.simpleString()

    def run(batches):
        own = own_encoder()
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.sizes_of(part.column(1).to_pylist()).astype(np.int64))], ["key", "size"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, size bigint").withColumnRenamed("key", key)

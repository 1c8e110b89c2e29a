"""Stores of vectors, postings and graphs as partitioned tables, keyed by id instead of position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quill.session import exists, written

BUCKETS = 64


def save_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    vectors.write.mode(mode).parquet(path)


def add_vectors(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding") -> None:
    """Appends vectors to a store. An error, and nothing is written, if one has no id, an id of the store, an id that recurs,
    or another dimension than those of the store."""
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    old = spark.read.parquet(path)
    first = old.filter(F.col(vector).isNotNull()).select(F.size(vector)).head(1)
    size = F.size(vector)
    n, ids, least, most = vectors.agg(F.count("*"), F.countDistinct(key), F.min(size), F.max(size)).first()
    if n and (least != most or least < 1 or first and first[0][0] != least):
        raise ValueError(f"vectors of {least} to {most} dimensions for a store of {first[0][0] if first else 'none'}")
    if ids != n or vectors.join(old.select(key), key, "left_semi").head(1):
        raise ValueError("ids of vectors are missing, recur or are in the store")
    vectors.select(*old.columns).write.mode("append").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_postings(postings: DataFrame, path: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Postings laid out by a hash of the token, so that a search for few tokens reads few folders."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("token").write.mode(mode).partitionBy("bucket").parquet(path)


def load_postings(spark: SparkSession, path: str, tokens: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """Postings of the store, or of some tokens; None where there is no store."""
    if not exists(spark, path):
        return None
    table = spark.read.schema("token string, chunk_id string, tf bigint, bucket int").parquet(path)
    if tokens is not None:
        wanted = spark.createDataFrame([(t,) for t in tokens], "token string")
        numbers = [r[0] for r in wanted.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).distinct().collect()]
        table = table.filter(F.col("bucket").isin(numbers) & F.col("token").isin(tokens))
    return table.drop("bucket")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")

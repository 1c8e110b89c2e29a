"""An index as a folder of tables: built in steps that can be resumed, appended to, renumbered and checked.

Tables: chunks (doc_id, posicion, texto, num_tokens, chunk_id, chunk_uid), vectors (chunk_id, embedding), postings (token,
chunk_id, tf), nodes and edges of the entity graph. Chunk ids are ordinals from 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quill.operators import encoding, graph, ranking
from quill.operators.ordinals import with_ordinal
from quill.operators.segmenting import numbered
from quill.plans import pipeline
from quill.session import delete, exists, written
from quill.sources import stores
from quill.streaming import append

REQUIRED = ("doc_id", "chunk_id", "fuente", "formato", "fenomeno", "posicion", "texto")


def build(docs: DataFrame, folder: str, options: pipeline.Options | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Writes all tables. A table that an earlier, interrupted build has finished is kept, so a build is resumed by calling
    it again."""
    options, spark = options or pipeline.Options(), docs.sparkSession

    def step(name: str, make) -> DataFrame:
        if not exists(spark, f"{folder}/{name}/_SUCCESS"):
            make().write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    chunks = step("chunks", lambda: pipeline.build_chunks(docs, options, key, text))
    step("vectors", lambda: encoding.encoded(chunks, "chunk_id", "texto", options.own_encoder()))
    if not exists(spark, f"{folder}/postings/_SUCCESS"):
        stores.save_postings(ranking.postings(chunks), f"{folder}/postings")
    if options.use_graph:
        mentions = step("mentions", lambda: graph.best_mentions(graph.recognised(chunks)))
        edges = step("edges", lambda: graph.pruned(graph.simple_edges(mentions)))
        step("nodes", lambda: graph.with_edges(graph.nodes(mentions), edges))


def append_documents(docs: DataFrame, folder: str, options: pipeline.Options | None = None, key: str = "doc_id", text: str = "text", dry_run: bool = False) -> tuple[int, int]:
    """Adds the documents with a text that the index doesn't have: chunks whose ids go on, their vectors and postings.
    (chunks, documents) added, or with ``dry_run`` to be added. Calling it again adds nothing, also after an interruption: what
    chunks have been added without vectors or postings gets these first."""
    options, spark = options or pipeline.Options(), docs.sparkSession
    chunks = spark.read.parquet(f"{folder}/chunks")
    if not dry_run:
        _complete(spark, folder, options)
    new = written(pipeline.build_chunks(append.missing(docs, chunks, key, text), options, key, text).drop("chunk_id", "chunk_uid"), "new")
    size = new.agg(F.count("*"), F.countDistinct(key)).first()
    if not dry_run and size[0]:
        total = chunks.agg(F.count("*")).first()[0]
        numbered(new, key, total).select(*chunks.columns).write.mode("append").parquet(f"{folder}/chunks")
        _complete(spark, folder, options)
        if problems := [tuple(r) for r in misaligned(spark, folder).collect()]:
            raise ValueError(f"index out of step: {problems}")
    return size[0], size[1]


def _complete(spark: SparkSession, folder: str, options: pipeline.Options) -> None:
    """Vectors and postings of chunks that have none."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    lacking = written(chunks.join(spark.read.parquet(f"{folder}/vectors").select("chunk_id"), "chunk_id", "left_anti"), "lacking")
    if lacking.head(1):
        stores.add_vectors(encoding.encoded(lacking, "chunk_id", "texto", options.own_encoder()), f"{folder}/vectors")
    with_terms = ranking.postings(chunks.join(stores.load_postings(spark, f"{folder}/postings").select("chunk_id").distinct(), "chunk_id", "left_anti"))
    new = written(with_terms, "terms")
    if new.head(1):
        stores.save_postings(new, f"{folder}/postings", "append")


def renumber(folder: str, spark: SparkSession, key: str = "doc_id") -> None:
    """Ordinal ids for an index that has others: chunks, vectors and postings; the old ones stay as chunk_uid where that is
    null. New tables are written beside the old and put in their place at the end."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    ids = written(with_ordinal(chunks.select(key, "posicion", F.col("chunk_id").alias("old")), [key, "posicion", "old"], "n").select("old", F.col("n").cast("string").alias("new")), "ids")
    if ids.select("old").distinct().count() != ids.count():
        raise ValueError("chunk ids recur: they can't be renumbered")
    moved = lambda df: df.join(ids, df["chunk_id"] == ids["old"])
    beside = f"{folder}/renumbered-{uuid.uuid4().hex}"
    moved(chunks).withColumn("chunk_uid", F.coalesce("chunk_uid", "old")).withColumn("chunk_id", F.col("new")).select(*chunks.columns).write.parquet(f"{beside}/chunks")
    moved(spark.read.parquet(f"{folder}/vectors")).select(F.col("new").alias("chunk_id"), "embedding").write.parquet(f"{beside}/vectors")
    stores.save_postings(moved(stores.load_postings(spark, f"{folder}/postings")).select("token", F.col("new").alias("chunk_id"), "tf"), f"{beside}/postings")
    for name in ("chunks", "vectors", "postings"):
        delete(spark, f"{folder}/{name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    delete(spark, beside)


def misaligned(spark: SparkSession, folder: str) -> DataFrame:
    """(problem, n) of an index: ids that aren't the ordinals, chunks without vector or the other way round, postings of unknown
    chunks. No rows for a sound one."""
    chunks = spark.read.parquet(f"{folder}/chunks").select("chunk_id")
    vectors, terms = spark.read.parquet(f"{folder}/vectors").select("chunk_id"), stores.load_postings(spark, f"{folder}/postings").select("chunk_id").distinct()
    return counted(("chunk ids not ordinal", not_ordinal(chunks)), ("chunks without vector", chunks.join(vectors, "chunk_id", "left_anti")), ("vectors without chunk", vectors.join(chunks, "chunk_id", "left_anti")), ("postings without chunk", terms.join(chunks, "chunk_id", "left_anti")))


def not_ordinal(chunks: DataFrame) -> DataFrame:
    """Chunk ids that aren't one of the numbers from 0 to their count less one, and ids that recur."""
    total = chunks.agg(F.count("*").alias("total"))
    counts = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    number = F.col("chunk_id").try_cast("bigint")
    fine = (F.col("n") == 1) & (number >= 0) & (number < F.col("total")) & (number.cast("string") == F.col("chunk_id"))
    return counts.filter(~F.coalesce(fine, F.lit(False))).select("chunk_id")


def counted(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(problem, n) of the checks with any row."""
    out = None
    for name, rows in checks:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out.filter("n > 0")


def package_problems(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, queries: DataFrame, cited: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n) of everything that is handed over: chunks (with REQUIRED columns), documents (doc_id), vectors (chunk_id),
    queries (query_id), cited (query_id, doc_id) and graph edges. All rows are looked at."""
    blank = lambda c: F.col(c).isNull() | (F.btrim(F.col(c).cast("string")) == "")
    none: Column = F.lit(False)
    for c in REQUIRED:
        none = none | blank(c)
    ids = chunks.select("chunk_id").filter("chunk_id IS NOT NULL").distinct()
    return counted(
        ("chunks with a missing field", chunks.filter(none)),
        ("chunks of unknown category", chunks.filter(~F.col("fenomeno").isin(1, 2, 3))),
        ("formats not in lower case", chunks.filter(F.col("formato") != F.lower("formato"))),
        ("chunk ids not ordinal", not_ordinal(ids)),
        ("chunks without vector", ids.join(vectors.select("chunk_id"), "chunk_id", "left_anti")),
        ("vectors without chunk", vectors.select("chunk_id").join(ids, "chunk_id", "left_anti")),
        ("chunks of unknown documents", chunks.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")),
        ("queries without result", queries.select("query_id").join(cited.select("query_id"), "query_id", "left_anti")),
        ("results of unknown queries", cited.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti")),
        ("cited documents without chunks", cited.select("doc_id").distinct().join(chunks.select("doc_id"), "doc_id", "left_anti")),
        ("graphs without edges", edges.agg(F.count("*").alias("edges")).filter("edges = 0")),
    )

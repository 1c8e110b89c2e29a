"""Queries of the engine's operators over the supplied tables, and SQL of the same results where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quill.functions import text as T
from quill.operators import approximate as A, evaluation as E, graph as G, ranking as R, segmenting as S
from quill.plans import pipeline, store
from quill.plans.oracles import SQL
from quill.session import read_table, shared_folder, written
from quill.sources import files, stores
from quill.streaming import append

_all: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _all[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _all}


# inputs


def docs(s, d):
    return read_table(s, d, "documents")


def chunk_rows(s, d, *columns):
    """One row for each chunk, of the columns asked for: rows sent again are equal but for loaded_at. None of them may be a
    text: those are in chunk_values."""
    return read_table(s, d, "chunk_meta").select(*(c for c in columns)).distinct()


def chunk_values(s, d, *values):
    """(chunk_id, doc_id, posicion, values): expressions over the chunks' texts, computed before rows sent again are dropped,
    so that only the values are shuffled."""
    rows = read_table(s, d, "chunk_meta").select("chunk_id", "doc_id", "posicion", F.xxhash64("texto").alias("_h"), *values)
    return rows.dropDuplicates(["chunk_id", "doc_id", "posicion", "_h"]).drop("_h")


def texts(s, d):
    """One row for each chunk. Texts are shuffled once, by chunk; only their hashes are compared."""
    return chunk_values(s, d, "texto")


def fragments(s, d):
    return read_table(s, d, "fragments").distinct()


def asked(s, d):
    return read_table(s, d, "eval_queries")


def clean_docs(s, d):
    return written(T.cleaned(docs(s, d).select("doc_id", "text")), "clean")


def two_rankings(s, d):
    """Two rankings of each query's fragments: as given, and the six longest; scores are exact in binary."""
    first = fragments(s, d).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max(F.length("text")).alias("n"))
    a = first.select("query_id", F.lit(0).alias("source"), F.col("rank").cast("bigint").alias("rank"), F.col("chunk_id").alias("item"), ((11 - F.col("rank")) / 16.0).alias("score"))
    b = R.top(first.select("query_id", "chunk_id", "n"), 6, ["query_id"], [F.desc("n"), F.asc("chunk_id")])
    return a.unionByName(b.select("query_id", F.lit(1).alias("source"), "rank", F.col("chunk_id").alias("item"), ((11 - F.col("rank")) / 8.0).alias("score")))


def fused_docs(s, d):
    fused = R.fuse(two_rankings(s, d), "rrf")
    of = fragments(s, d).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return fused.join(of, fused["item"] == of["chunk_id"]).select("query_id", "rank", "doc_id", "score")


def cited(s, d):
    """The three documents of each query: its fragments' documents by first rank."""
    first = fragments(s, d).groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    return R.top(first, 3, ["query_id"], [F.asc("r"), F.asc("doc_id")]).select("query_id", "rank", "doc_id")


def path_of(s, d):
    return docs(s, d).select(F.col("doc_code").alias("doc_id"), "fuente", F.coalesce("fenomeno", F.lit(0)).alias("fenomeno"), "source")


def grades(s, d):
    return asked(s, d).select("query_id", F.explode("relevantes").alias("fuente", "grade"))


def graded(s, d):
    """(query_id, rank, grade): grade of each fragment by the path of its document, 0 where it has none."""
    one = E.best_of(fragments(s, d), ["query_id", "rank"], [F.asc("chunk_id"), F.asc("doc_id")]).join(path_of(s, d).select("doc_id", "fuente"), "doc_id", "left")
    return one.join(grades(s, d), ["query_id", "fuente"], "left").select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def pool(s, d):
    counts = chunk_rows(s, d, "fuente", "chunk_id").groupBy("fuente").agg(F.countDistinct("chunk_id").alias("n"))
    return grades(s, d).join(counts, "fuente").select("query_id", "grade", "n")


def relevant(s, d):
    return grades(s, d).filter("grade > 0").select("query_id", F.col("fuente").alias("item"))


def retrieved(s, d):
    return cited(s, d).join(path_of(s, d), "doc_id", "left").select("query_id", F.coalesce("fuente", F.lit("")).alias("item"))


def mentioned(s, d):
    """(chunk_id, pos, name, score) of each chunk; names are found before rows sent again are dropped."""
    return chunk_values(s, d, G.names("texto").alias("names")).select("chunk_id", F.posexplode("names").alias("pos", "name")).withColumn("score", F.length("name"))


def mention_rows(s, d):
    return G.best_mentions(mentioned(s, d))


def mention_tables(s, d):
    mentions = written(mention_rows(s, d), "mentions")
    edges = written(G.pruned(G.simple_edges(mentions)), "edges")
    return mentions, written(G.with_edges(G.nodes(mentions), edges), "nodes"), edges


def graph_tables(s, d):
    return mention_tables(s, d)[1:]


def query_keys(s, d):
    return G.recognised(asked(s, d), "query_id", "text").select("query_id", G.normal_name("name").alias("key")).distinct()


# cleaning


@query
def unicode_fix(s, d):
    return docs(s, d).select("doc_id", T.unicode_fix("text").alias("text"))


@query
def boilerplate_lines(s, d):
    fixed = docs(s, d).select("doc_id", T.unicode_fix("text").alias("text"))
    return fixed.select("doc_id", F.explode(T.boilerplate(F.split("text", "\n", -1))).alias("line"))


@query
def noise_lines(s, d):
    fixed = docs(s, d).select("doc_id", T.unicode_fix("text").alias("text"))
    return fixed.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(T.noise_line(F.col("line"))).select("doc_id", "line_no")


@query
def clean_document(s, d):
    return T.cleaned(docs(s, d).select("doc_id", "text"))


@query
def dehyphenate(s, d):
    return docs(s, d).select("doc_id", T.dehyphenate("text").alias("text"))


# segmentation


@query
def sentences(s, d):
    return clean_docs(s, d).select("doc_id", F.posexplode(S.sentence_array("text")).alias("n", "sentence"))


@query
def sentence_cap(s, d):
    found = clean_docs(s, d).select("doc_id", S.sentence_array("text").alias("sentences"))
    return found.select("doc_id", F.posexplode(S.capped(F.col("sentences"), 20)).alias("n", "part"))


@query
def chunk_pack(s, d):
    return S.chunks(clean_docs(s, d), most=64, overlap=1)


@query
def approx_tokens(s, d):
    return chunk_values(s, d, T.word_count("texto").alias("n")).select("chunk_id", "n")


@query
def filter_min_chars(s, d):
    sized = chunk_values(s, d, F.length("texto").alias("n")).filter("n IS NOT NULL").withColumn("posicion", F.coalesce("posicion", F.lit(-1)))
    return S.kept_chunks(sized, 250, size="n").select("doc_id", "chunk_id")


@query
def cap_per_doc(s, d):
    rows = chunk_rows(s, d, "doc_id", "posicion")
    return S.first_chunks(rows, 3)


@query
def split_output(s, d):
    return texts(s, d).select("chunk_id", F.posexplode(S.output_parts("texto", 40)).alias("n", "part"))


@query
def split_secondary(s, d):
    return texts(s, d).select("chunk_id", F.posexplode(S.secondary(F.col("texto"), 25)).alias("n", "part"))


@query
def well_formed(s, d):
    return chunk_values(s, d, T.opens_well("texto").alias("opens"), T.closes_well("texto").alias("closes")).select("chunk_id", "opens", "closes")


@query
def chunk_ids(s, d):
    return S.numbered(chunk_rows(s, d, "doc_id", "posicion").filter("posicion IS NOT NULL"))


# index and search


@query
def l2_normalize(s, d):
    return read_table(s, d, "embeddings").select("vec_id", F.posexplode(R.unit("embedding")).alias("dim", "x")).select("vec_id", "dim", F.round("x", 5).alias("x"))


@query
def dense_topk(s, d):
    v = read_table(s, d, "embeddings")
    return R.dense_top(v, v.filter("vec_id % 20 = 0"), 10)


@query
def dense_topk_cells(s, d):
    """Approximate search; tests hold its recall against dense_topk."""
    v = read_table(s, d, "embeddings")
    fitted = A.fit(v)
    return A.approximate_top(A.index(v, fitted), fitted, v.filter("vec_id % 20 = 0"), 10)


@query
def postings_build(s, d):
    return R.postings(texts(s, d))


@query
def sparse_topk(s, d):
    return R.sparse_top(written(texts(s, d), "texts"), asked(s, d), 20)


@query
def index_stats(s, d):
    p = R.postings(texts(s, d))
    return p.agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("token").alias("tokens"), F.sum("tf").alias("occurrences"))


@query
def vector_store(s, d):
    path = f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}"
    stores.save_vectors(read_table(s, d, "embeddings"), path)
    return stores.load_vectors(s, path).select("vec_id", "label")


# fusion and selection


@query
def fuse_combsum(s, d):
    return R.fuse(two_rankings(s, d), "combsum", {0: 1.0, 1: 0.5})


@query
def fuse_combmnz(s, d):
    return R.fuse(two_rankings(s, d), "combmnz", {0: 1.0, 1: 0.5})


@query
def fuse_rrf(s, d):
    return R.fuse(two_rankings(s, d), "rrf", {0: 1.0, 1: 0.25})


@query
def fuse_passthrough(s, d):
    return R.fuse(two_rankings(s, d).filter("source = 1"), "rrf", {1: 0.25})


@query
def rerank(s, d):
    one = E.best_of(fragments(s, d), ["query_id", "chunk_id"], [F.asc("rank"), F.asc("text")])
    full = one.join(asked(s, d).select("query_id", F.col("text").alias("query")), "query_id")
    return R.rerank(full.select("query_id", "rank", F.col("chunk_id").alias("item"), "query", "text"), 6)


@query
def agg_max_pool(s, d):
    return R.documents_of(fused_docs(s, d), "max_pool")


@query
def agg_sum(s, d):
    return R.documents_of(fused_docs(s, d), "sum")


@query
def agg_weighted_mean(s, d):
    return R.documents_of(fused_docs(s, d), "weighted_mean")


def _centroids(s, d):
    v = read_table(s, d, "embeddings")
    hits = R.dense_top(v, v.filter("vec_id % 20 = 0"), 40)
    return v, hits, R.centroids(hits, v, "label")


@query
def doc_centroid(s, d):
    return _centroids(s, d)[2].select("query_id", "label", F.posexplode("centroid").alias("dim", "x")).select("query_id", "label", "dim", F.round("x", 4).alias("x"))


@query
def diverse_docs(s, d):
    v, hits, middle = _centroids(s, d)
    scored = hits.join(v.select("vec_id", F.col("label").alias("doc_id")), "vec_id").select("query_id", "rank", "doc_id", "score")
    pool_ = R.documents_of(scored, "max_pool", 18).withColumnRenamed("doc_id", "label")
    return R.diverse(pool_.join(middle, ["query_id", "label"]), "label", 3, 0.3)


@query
def select_fragments_split(s, d):
    """The same with fragments of at most 25 words, so that most texts are divided."""
    one = E.best_of(fragments(s, d), ["query_id", "rank"], [F.asc("chunk_id"), F.asc("doc_id"), F.asc("text")])
    return R.fragments_of(one.select("query_id", "rank", "chunk_id", "doc_id", "text"), 5, 25, 8)


@query
def select_fragments(s, d):
    one = E.best_of(fragments(s, d), ["query_id", "rank"], [F.asc("chunk_id"), F.asc("doc_id"), F.asc("text")])
    return R.fragments_of(one.select("query_id", "rank", "chunk_id", "doc_id", "text"), 5)


@query
def retrieve(s, d):
    documents, found = pipeline.answer(written(texts(s, d).filter("texto IS NOT NULL").select("chunk_id", "doc_id", "texto"), "chunks"), asked(s, d).select("query_id", "text"))
    return documents.select("query_id", F.lit("document").alias("kind"), "rank", F.col("doc_id").alias("item"), F.lit(None).cast("string").alias("text")).unionByName(
        found.select("query_id", F.lit("fragment").alias("kind"), "rank", F.col("chunk_id").alias("item"), "text")
    )


@query
def build_index(s, d):
    return pipeline.build_chunks(docs(s, d), pipeline.Options(max_tokens=64))


def _late(s, d):
    """Documents, and whether they came in during the last tenth of the time."""
    span = docs(s, d).agg(F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b")).select((F.unix_timestamp("b") - F.floor((F.unix_timestamp("b") - F.unix_timestamp("a")) / 10)).alias("from"))
    one = F.lit(1).alias("_k")
    return docs(s, d).withColumn("_k", one).join(F.broadcast(span.withColumn("_k", one)), "_k").select("doc_id", "text", F.coalesce(F.unix_timestamp("ingested_at") >= F.col("from"), F.lit(False)).alias("late"))


@query
def append_documents(s, d):
    """An index of the documents but the late ones, to which these are appended."""
    folder, options = f"{shared_folder(s)}/index-{uuid.uuid4().hex}", pipeline.Options(max_tokens=64, dimensions=16, use_graph=False)
    every = _late(s, d)
    store.build(every.filter("NOT late"), folder, options)
    store.append_documents(every, folder, options)
    return s.read.parquet(f"{folder}/chunks").select("doc_id", "posicion", "num_tokens", "chunk_id", "chunk_uid")


@query
def sparse_store(s, d):
    path = f"{shared_folder(s)}/postings-{uuid.uuid4().hex}"
    stores.save_postings(R.postings(texts(s, d)), path)
    return stores.load_postings(s, path)


@query
def graph_store(s, d):
    path = f"{shared_folder(s)}/graph-{uuid.uuid4().hex}"
    stores.save_graph(*graph_tables(s, d), path)
    return stores.load_graph(s, path)[1]


# graph


@query
def entity_normalize(s, d):
    return mentioned(s, d).select("chunk_id", "pos", G.normal_name("name").alias("name"))


@query
def graph_build_simple(s, d):
    return G.simple_edges(R.top(mentioned(s, d), 8, ["chunk_id"], [F.asc("pos")], "_n").select("chunk_id", "pos", "name"))


@query
def graph_build(s, d):
    return G.simple_edges(mention_rows(s, d))


@query
def graph_nodes(s, d):
    return G.nodes(mention_rows(s, d)).select("name", F.array_join("chunks", ",").alias("chunks"))


@query
def graph_prune(s, d):
    node, _ = graph_tables(s, d)
    return node.select("name", F.size("chunks").alias("n"))


@query
def entity_link(s, d):
    node, _ = graph_tables(s, d)
    return G.linked(query_keys(s, d), node)


@query
def graph_topk(s, d):
    mentions, node, edges = mention_tables(s, d)
    return G.graph_top(G.linked(query_keys(s, d), node).select("query_id", "name"), mentions.select("name", "chunk_id"), edges, 20)


# evaluation


@query
def dcg(s, d):
    return E.dcg(graded(s, d))


@query
def ndcg(s, d):
    return E.ndcg(graded(s, d), pool(s, d))


@query
def f1_at_3(s, d):
    return E.f1_at_3(retrieved(s, d), relevant(s, d))


@query
def competition_rank(s, d):
    return E.competition_rank(docs(s, d).filter("source IS NOT NULL").groupBy("source").agg(F.round(F.avg("n_chars"), 0).alias("score")), "score")


@query
def borda_points(s, d):
    return E.borda_points(docs(s, d).filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("score")), "score").select("source", "points")


@query
def borda_leaderboard(s, d):
    a = docs(s, d).filter("source IS NOT NULL").groupBy("source").agg(F.count("*").cast("double").alias("first"))
    b = docs(s, d).filter("source IS NOT NULL AND idioma = 'es'").groupBy("source").agg(F.countDistinct("titulo").cast("double").alias("second"))
    return E.borda_leaderboard(a, b, "source", "first", "second")


@query
def evaluate(s, d):
    n, f = E.ndcg(graded(s, d), pool(s, d)), E.f1_at_3(retrieved(s, d), relevant(s, d))
    both = n.join(f, "query_id", "full")
    return both.agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 5).alias("mean_ndcg"), F.round(F.avg("f1"), 5).alias("mean_f1"))


@query
def weak_labels(s, d):
    return E.weak_labels(read_table(s, d, "manifest"))


@query
def sweep(s, d):
    """Leaderboard of three ways of aggregating chunks to documents by F1 and by mean score."""
    found = written(pipeline.variants(fused_docs(s, d), ["max_pool", "sum", "weighted_mean"]), "variants").join(path_of(s, d).select("doc_id", "fuente"), "doc_id", "left")
    rows = found.select(F.concat_ws("\x1f", "variant", "query_id").alias("k"), "variant", "query_id", F.coalesce("fuente", F.lit("")).alias("item"), "score")
    want = rows.select("k", "query_id").distinct().join(relevant(s, d), "query_id").select("k", "item")
    f1 = E.f1_at_3(rows, want, "k").select(F.split_part("k", F.lit("\x1f"), F.lit(1)).alias("variant"), "f1").groupBy("variant").agg(F.round(F.avg("f1"), 5).alias("f1"))
    mean = rows.groupBy("variant").agg(F.round(F.avg("score"), 5).alias("score"))
    return E.borda_leaderboard(f1, mean, "variant", "f1", "score")


def _scored(ranked, s, d, item):
    """(variant, f1, ndcg): means over the queries of documents ranked by a variant; ``ranked``: (variant, query_id, rank, item)
    with the items' paths in ``item``."""
    rows = ranked.withColumn("k", F.concat_ws("\x1f", "variant", "query_id"))
    of = rows.select("k", "variant", "query_id").distinct()
    f1 = E.f1_at_3(rows.select("k", F.col(item).alias("item")), of.join(relevant(s, d), "query_id").select("k", "item"), "k")
    marks = rows.join(grades(s, d).withColumnRenamed("fuente", item), ["query_id", item], "left").select("k", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))
    gain = E.ndcg(marks, of.join(pool(s, d), "query_id").select("k", "grade", "n"), 10, "k")
    both = of.select("k", "variant").join(f1, "k", "left").join(gain, "k", "left")
    return both.groupBy("variant").agg(F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 5).alias("f1"), F.round(F.avg(F.coalesce("ndcg", F.lit(0.0))), 5).alias("ndcg"))


@query
def sweep_tokens(s, d):
    """Leaderboard of nine configurations: chunks of 64, 96 and 128 tokens, each with three ways of aggregating them."""
    clean, paths = clean_docs(s, d), docs(s, d).select(F.col("doc_id"), "fuente")
    out = None
    for most in (64, 96, 128):
        chunks = S.numbered(written(S.chunks(clean, most=most), "chunks"))
        hits = written(R.sparse_top(chunks, asked(s, d), 100).join(chunks.select("chunk_id", "doc_id"), "chunk_id"), "hits")
        found = pipeline.variants(hits.select("query_id", "rank", "doc_id", "score"), ["max_pool", "sum", "weighted_mean"]).withColumn("variant", F.concat(F.lit(f"{most} "), "variant"))
        out = found if out is None else out.unionByName(found)
    scored = _scored(written(out.join(paths, "doc_id").select("variant", "query_id", "rank", "fuente"), "variants"), s, d, "fuente")
    return E.borda_leaderboard(scored.select("variant", "ndcg"), scored.select("variant", "f1"), "variant", "ndcg", "f1")


@query
def compare_variants(s, d):
    """Leaderboard of dense search with two encoders, lexical search and both fused, each with and without reranking."""
    chunks = written(texts(s, d).filter("texto IS NOT NULL").select("chunk_id", "doc_id", "texto"), "chunks")
    searches = {f"dense {n}": pipeline.Options(dimensions=n, use_graph=False, candidates=40) for n in (32, 256)}
    ranked = {name: written(pipeline.rankings(chunks, asked(s, d), options), "ranked") for name, options in searches.items()}
    lists = {name: r.filter("source = 0").select("query_id", "rank", "item", "score") for name, r in ranked.items()}
    lists |= {"lexical": ranked["dense 256"].filter("source = 1").select("query_id", "rank", "item", "score"), "both": R.fuse(ranked["dense 256"], "rrf", [1.0, 1.0], sources=2)}
    listed = None
    for name, r in lists.items():
        one = r.withColumn("variant", F.lit(name))
        listed = one if listed is None else listed.unionByName(one)
    full = written(listed.withColumnRenamed("item", "chunk_id").join(chunks, "chunk_id").join(asked(s, d).select("query_id", F.col("text").alias("query")), "query_id"), "listed")
    again = R.rerank(full.select(F.concat_ws("\x1f", "variant", "query_id").alias("query_id"), "rank", F.struct("chunk_id", "doc_id").alias("item"), "query", F.col("texto").alias("text")), 40)
    again = again.select(F.concat(F.split_part("query_id", F.lit("\x1f"), F.lit(1)), F.lit(" reranked")).alias("variant"), F.split_part("query_id", F.lit("\x1f"), F.lit(2)).alias("query_id"), "rank", "item.doc_id", "score")
    every = full.select("variant", "query_id", "rank", "doc_id", "score").unionByName(again).withColumn("query_id", F.concat_ws("\x1f", "variant", "query_id"))
    found = R.documents_of(every, "max_pool").select(F.split_part("query_id", F.lit("\x1f"), F.lit(1)).alias("variant"), F.split_part("query_id", F.lit("\x1f"), F.lit(2)).alias("query_id"), "rank", "doc_id")
    scored = _scored(written(found.join(path_of(s, d), "doc_id").select("variant", "query_id", "rank", "fuente"), "variants"), s, d, "fuente")
    return E.borda_leaderboard(scored.select("variant", "ndcg"), scored.select("variant", "f1"), "variant", "ndcg", "f1")


# checks and reports


@query
def validate_chunks(s, d):
    return E.chunk_errors(read_table(s, d, "chunk_meta"), ["doc_id", "chunk_id", "fuente", "formato", "fenomeno", "posicion", "num_tokens", "texto"])


@query
def validate_results(s, d):
    """Errors of results of which documents without category and fragments of fewer than 30 words have been taken out."""
    known = cited(s, d).join(path_of(s, d).filter("fenomeno <> 0").select("doc_id"), "doc_id", "left_semi")
    return E.result_errors(pipeline.results(known, fragments(s, d).filter(T.word_count("text") >= 30).withColumn("rank", F.col("rank").cast("bigint"))))


@query
def validate_sequence(s, d):
    return E.sequence_errors(asked(s, d))


@query
def orphan_docs(s, d):
    """Cited documents that no chunk has, and documents of chunks that the corpus doesn't have."""
    chunks = chunk_rows(s, d, "doc_id")
    cited_only = cited(s, d).select("doc_id").distinct().join(chunks, "doc_id", "left_anti")
    return cited_only.unionByName(chunks.join(path_of(s, d).select("doc_id"), "doc_id", "left_anti").filter("doc_id IS NOT NULL"))


@query
def package_check(s, d):
    """Problems of the tables taken as a package that is handed over; the vectors are those of the embeddings table."""
    chunks = read_table(s, d, "chunk_meta").select("chunk_id", "doc_id", "fuente", "formato", "fenomeno", "posicion", F.col("texto").substr(1, 1).alias("texto"))
    vectors = read_table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"))
    mentions = written(mention_rows(s, d), "mentions")
    return store.package_problems(chunks, path_of(s, d), vectors, asked(s, d), cited(s, d), G.pruned(G.simple_edges(mentions)))


@query
def qa_coherence(s, d):
    both = cited(s, d).join(path_of(s, d), "doc_id", "left").join(asked(s, d).select("query_id", F.col("fenomeno").alias("wanted")), "query_id")
    return both.groupBy("query_id", "wanted").agg(F.count_if(F.col("fenomeno") == F.col("wanted")).alias("hits")).filter("hits = 0").select("query_id", "wanted")


@query
def qa_omnipresent(s, d):
    return E.omnipresent(cited(s, d))


@query
def qa_mono_source(s, d):
    """Queries, of the evaluation and of the manifest, whose first documents are all of one source."""
    listed = read_table(s, d, "manifest").filter("rank_en_query <= 10").select(F.col("query").alias("query_id"), "fuente")
    both = cited(s, d).join(path_of(s, d), "doc_id", "left").select("query_id", "fuente").unionByName(listed).withColumn("place", F.coalesce(F.nullif(F.split_part("fuente", F.lit("/"), F.lit(2)), F.lit("")), F.lit("?")))
    return both.groupBy("query_id").agg(F.countDistinct("place").alias("n")).filter("n = 1").select("query_id")


@query
def qa_fragments(s, d):
    w = fragments(s, d).select("text", T.word_count("text").alias("w"))
    return w.agg(F.min("w").alias("least"), F.floor(F.sum("w") / F.count("*")).alias("mean"), F.max("w").alias("most"), F.count_if(F.col("w") < 10).alias("nearly_empty"), (F.count("text") - F.countDistinct("text")).alias("repeated"))


@query
def ab_overlap(s, d):
    f = fragments(s, d)
    b_docs = f.groupBy("query_id", "doc_id").agg(F.max("rank").alias("r"))
    listed = lambda df, n: df.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    words = lambda lo, hi: f.filter(F.col("rank").between(lo, hi)).groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    a = listed(cited(s, d), 3).join(words(1, 8), "query_id")
    b = listed(R.top(b_docs, 3, ["query_id"], [F.asc("r"), F.asc("doc_id")]), 3).join(words(3, 10), "query_id")
    return E.overlap(a, b)


@query
def ab_indicators(s, d):
    both = cited(s, d).join(path_of(s, d), "doc_id", "left").join(asked(s, d).select("query_id", F.col("fenomeno").alias("wanted")), "query_id", "left")
    total = both.agg(F.round(F.count_if(F.col("fenomeno") == F.col("wanted")) / F.count("*"), 6).alias("coherence"), F.countDistinct("doc_id").alias("documents"))
    most = both.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(1).select(F.col("doc_id").alias("most_cited"), "n")
    single = both.groupBy("query_id").agg(F.countDistinct("source").alias("k")).agg(F.count_if(F.col("k") == 1).alias("mono_source"))
    one = F.lit(1).alias("_k")
    return total.withColumn("_k", one).join(most.withColumn("_k", one), "_k").join(single.withColumn("_k", one), "_k").drop("_k")


# sources


@query
def inventory_reader(s, d):
    return files.inventory(read_table(s, d, "inventory"))


@query
def corpus_scan(s, d):
    return files.scan(docs(s, d).select("fuente"), files.inventory(read_table(s, d, "inventory")))


@query
def corpus_scan_plain(s, d):
    return files.scan(docs(s, d).select("fuente"))


@query
def format_detect(s, d):
    return docs(s, d).select("doc_id", files.file_format("fuente").alias("logical"), files.extension("fuente").alias("extension"))


@query
def path_phenomenon(s, d):
    return docs(s, d).select("doc_id", files.phenomenon("fuente").alias("fenomeno"))


@query
def json_harvest(s, d):
    return read_table(s, d, "events").select("event_id", files.json_text("props").alias("text"))


@query
def row_serialize(s, d):
    part = read_table(s, d, "part")
    return part.select("p_partkey", files.row_text(part, ["p_name", "p_brand", "p_type", "p_size"]).alias("text"))


@query
def html_extract(s, d):
    return docs(s, d).filter("formato = 'html'").select("doc_id", files.html_text("text").alias("text"))


@query
def extraction_resume(s, d):
    listed = docs(s, d).select(F.col("doc_code").alias("doc_id"), "fuente")
    return files.to_extract(listed, read_table(s, d, "extraction_log"))


@query
def extraction_last(s, d):
    return files.last_attempts(read_table(s, d, "extraction_log").distinct()).select("doc_id", "n_chars", "error")


@query
def scans_to_read(s, d):
    return files.to_read_again(read_table(s, d, "extraction_log").distinct()).select("doc_id")


@query
def jsonl_roundtrip(s, d):
    path = f"{shared_folder(s)}/jsonl-{uuid.uuid4().hex}"
    rows = asked(s, d).select("query_id", "text", "idioma", "fenomeno")
    files.write_jsonl(rows, path, ["query_id"])
    return files.read_jsonl(s, path, rows.schema)


# incremental


@query
def append_missing(s, d):
    indexed = chunk_rows(s, d, "doc_id")
    return append.missing(docs(s, d).select(F.col("doc_code").alias("doc_id"), "text"), indexed).select("doc_id")


@query
def migrate_ids(s, d):
    return append.migrated(chunk_rows(s, d, "doc_id", "posicion", "chunk_id").filter("posicion IS NOT NULL").groupBy("doc_id", "posicion").agg(F.min("chunk_id").alias("chunk_id")))

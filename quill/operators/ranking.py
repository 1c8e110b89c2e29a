"""Search, fusion, reranking and selection over rankings.

A ranking is rows (query_id, source, rank, item, score). Ties are always broken by a stated order. Floats are rounded to
DIGITS before they order rows, so that the order of additions doesn't decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from quill.functions import text as T
from quill.operators.joins import join_checked
from quill.operators.segmenting import output_parts
from quill.session import cut

DIGITS = 6
#: Vectors in a block of the exact search, queries multiplied with it at a time, and queries sent to every task at a time.
BLOCK, STEP, QUERIES = 4096, 512, 32_768
#: Terms of queries sent to every task at a time, and texts of a task's first block and of the others.
TERMS, FIRST, TEXTS = 1_000_000, 4096, 65_536


def top(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank, 1 the first; a row_number filter, which Spark limits per partition."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col(name) <= k)


class Best:
    """The k best of each query in a task, over all of its blocks: equal scores by key. What a block offers below the k-th
    best so far is out, so few rows leave a task, however many it scored."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, np.zeros(queries, np.int64)
        self.scores, self.keys = np.full((queries, k), -np.inf), np.empty((queries, k), object)
        #: The k-th best of each query: less can't come in.
        self.least = np.full(queries, -np.inf)

    def offer(self, q: int, keys: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            keys, scores = keys[keep], scores[keep]
        n = self.n[q]
        s, own = np.concatenate((self.scores[q, :n], scores)), np.concatenate((self.keys[q, :n], keys))
        order = np.argsort(own, kind="stable")
        order = order[np.argsort(-s[order], kind="stable")][: self.k]
        n = self.n[q] = len(order)
        self.scores[q, :n], self.keys[q, :n] = s[order], own[order]
        if n == self.k:
            self.least[q] = s[order[-1]]

    def batches(self, kind: pa.DataType, first: int = 0, rows: int = 1 << 16):
        """(q, key, score); q counts from ``first``."""
        step = max(1, rows // self.k)
        for at in range(0, len(self.n), step):
            n = self.n[at : at + step]
            inside = np.arange(self.k) < n[:, None]
            q = np.repeat(np.arange(at, at + len(n)) + first, n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.keys[at : at + step][inside].tolist(), kind), pa.array(self.scores[at : at + step][inside])], ["q", "key", "score"])


def few_parts(df: DataFrame) -> DataFrame:
    """df in no more parts than there are cores, without a shuffle: each part passes on its best of every query."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def numbered_queries(found: DataFrame, ids: pa.Array, of: np.ndarray, k: int, key: str) -> DataFrame:
    """(query_id, rank, key, score): found is (q, key, score), and query ids[i] has the results of q = of[i]."""
    best = top(found, k, ["q"], [F.desc("score"), F.asc("key")])
    names = found.sparkSession.createDataFrame(pa.table({"query_id": ids, "q": pa.array(of.astype(np.int32))}))
    return join_checked(best, cut(names), ["q"]).select("query_id", "rank", F.col("key").alias(key), "score")


def unit(v: str | Column) -> Column:
    """Vector divided by its length; a zero vector stays."""
    c = T.lit_or_col(v)
    return T.let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), lambda n: F.transform(c, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): exact inner products of every query with every vector, the k best of each.

    Each task multiplies its vectors with all queries and passes on the k best of each query only; more than QUERIES
    queries go in groups. Null vectors take no part; a vector of another dimension than the queries' is an error.
    """
    asked = _present(queries, key, vector)
    size = asked.select(F.size("v").alias("n")).agg(F.max("n")).first()[0] or 0
    asked = cut(_present(queries, key, vector, size))
    groups = max(1, -(-asked.count() // QUERIES))
    out = None
    for g in range(groups):
        part = _multiplied_in_tasks(_present(vectors, key, vector, size), asked.filter(F.pmod(F.xxhash64("key"), F.lit(groups)) == g), k, key)
        out = part if out is None else out.unionByName(part)
    return out


def _present(vectors: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(key, v) of rows with both. ``size``: the dimension that all must have; any other is an error of the running query."""
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    if size is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"vectors of {size} dimensions, but one of "), F.size("v").cast("string"))).cast("array<double>")
    return rows.select("key", F.when(F.size("v") == size, F.col("v")).otherwise(wrong).alias("v"))


def _product(sparse: list | None, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of queries and vectors, both float32; queries with few values other than 0 by these alone."""
    if sparse is None:
        return q @ v.T
    columns, spare = np.ascontiguousarray(v.T), np.empty(len(v), np.float32)
    out = np.zeros((len(q), len(v)), np.float32)
    for row, (where, values) in zip(out, sparse):
        for d, x in zip(where, values):
            np.multiply(columns[d], x, out=spare)
            np.add(row, spare, out=row)
    return out


def _multiplied_in_tasks(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """Both (key, v). Products are made in single precision, and those that may be among the k best again in double."""
    kind = vectors.schema["key"].dataType.simpleString()
    asked = queries.toArrow()
    ids, n = asked.column("key").combine_chunks(), asked.num_rows
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in asked.column("v").chunks]
    matrix = np.concatenate(flat).reshape(n, -1).astype(np.float32 if all((x == x.astype(np.float32)).all() for x in flat) else np.float64) if n else np.zeros((0, 0))
    del asked, flat

    def run(batches):
        best = Best(n, k)
        q64, q32 = matrix, matrix.astype(np.float32)
        length = np.linalg.norm(q64.astype(np.float64), axis=1)
        thin = np.count_nonzero(q32) * 8 <= q32.size
        sparse = [((w := np.flatnonzero(x)).tolist(), x[w].tolist()) for x in q32] if thin else None
        for whole in batches if n else ():
            for first in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(first, BLOCK)
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                keys = np.array([*batch.column(0).to_pylist(), None], object)[:-1]
                small, far = own.astype(np.float32), float(np.abs(own).max(initial=0)) * own.shape[1] ** 0.5
                # the most by which a product in single precision, and a score by its rounding, can be off
                off = (own.shape[1] + 8) * 2.0**-23 * length * far + 10.0**-DIGITS
                exact = not (np.isfinite(off).all() and far < 1e15 and length.max() < 1e15)
                for a in range(0, n, STEP):
                    z = min(n, a + STEP)
                    s = q64[a:z].astype(np.float64) @ own.T if exact else _product(sparse and sparse[a:z], q32[a:z], small)
                    bound = best.least[a:z]
                    fresh = np.flatnonzero(bound == -np.inf)
                    if len(fresh) and s.shape[1] > k:
                        bound = bound.copy()
                        bound[fresh] = np.partition(s[fresh], -k, axis=1)[:, -k] - off[a:z][fresh]
                    i, j = np.nonzero(~(s < (bound - off[a:z])[:, None])) if not exact else np.nonzero(~(s < bound[:, None]))
                    cuts = np.flatnonzero(np.diff(i, prepend=-1))
                    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
                        row, some = a + int(i[x]), j[x:y]
                        score = np.round(own[some] @ q64[row].astype(np.float64), DIGITS) + 0.0
                        keep = ~(score < best.least[row])
                        if keep.any():
                            best.offer(row, keys[some[keep]], score[keep])
        yield from best.batches(vectors_kind)

    vectors_kind = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    return numbered_queries(few_parts(vectors).mapInArrow(run, f"q int, key {kind}, score double"), ids, np.arange(n), k, key)


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "texto") -> DataFrame:
    """(token, key, tf). Texts without tokens have no postings; counts are added up map-side before they are shuffled."""
    return chunks.select(key, F.explode(T.tokens(text)).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(key, F.explode(T.tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("qw"))


#: The runs of letters and numbers of functions.text.tokens, which the tasks of a small search find themselves.
_token = regex.compile(r"[\p{L}\p{N}]+")


def sparse_top(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "texto") -> DataFrame:
    """(query_id, rank, key, score): sum over shared tokens of query count times (1 + ln tf) ln(1 + N / df), best k.

    Each task scores its chunks against all queries, a block at a time over the block's postings, and passes on the k best
    of each query only. Queries of equal terms are one; more than TERMS terms, or QUERIES queries, go in groups of queries.
    """
    terms = cut(query_terms(queries))
    wanted = cut(terms.select("token").distinct())
    n = chunks.count()
    seen = join_checked(chunks.select(F.explode(F.array_distinct(T.tokens(text))).alias("token")), wanted, ["token"], "left_semi")
    df = cut(seen.groupBy("token").agg(F.count("*").alias("df")).select("token", F.log(1 + F.lit(float(n)) / F.col("df")).alias("idf")))
    weighed = join_checked(terms, df, ["token"]).select("query_id", "token", (F.col("qw") * F.col("idf")).alias("w"))
    lists = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.negative("w").alias("w"), "token"))).alias("terms"))
    sets = cut(lists.groupBy("terms").agg(F.collect_list("query_id").alias("ids")))
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    groups = max(1, -(-count // QUERIES), min(count, -(-total // max(1, TERMS))))
    out = None
    for g in range(groups):
        part = _scored_in_tasks(chunks, sets.filter(F.pmod(F.xxhash64("terms"), F.lit(groups)) == g), k, key, text)
        out = part if out is None else out.unionByName(part)
    return out


class Postings:
    """Postings of a block of texts: for each term the places of its texts and their 1 + ln tf; terms of an eighth of the
    texts also as a row."""

    def __init__(self, texts: list, place: dict[str, int]):
        n, number = len(texts), len(place)
        terms, rows = [], []
        for i, t in enumerate(texts):
            if t:
                found = [x for x in map(place.get, _token.findall(t.lower())) if x is not None]
                terms += found
                rows.append((i, len(found)))
        at = np.repeat(np.array([i for i, _ in rows], np.int64), np.array([c for _, c in rows], np.int64))
        codes, tf = np.unique(np.array(terms, np.int64) * n + at, return_counts=True)
        self.n, self.rows, self.values = n, codes % max(1, n), 1 + np.log(tf)
        self.starts = np.searchsorted(codes, np.arange(number + 1) * n)
        self.df = np.diff(self.starts)
        self.most = np.zeros(number)
        some = np.flatnonzero(self.df)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.values, self.starts[some])
        self.whole: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(self.df > n / 8).tolist():
            self.whole[t] = np.zeros(n)
            r, v = self.of(t)
            self.whole[t][r] = v

    def of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[t], self.starts[t + 1]
        return self.rows[a:b], self.values[a:b]


def _score_block(own: Postings, keys: np.ndarray, best: Best, at: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
    """Offers the texts of a block to all queries; query q has the terms at[q]:at[q + 1], the heaviest first. Texts that
    have only terms whose greatest weights together stay below the query's k-th best aren't looked at: none can come in."""
    up = weights * own.most[terms]
    sums = np.concatenate(([0.0], np.cumsum(up)))
    rest = np.repeat(sums[at[1:]], np.diff(at)) - sums[:-1]  # of this term and those after it
    least = best.least - 10.0 ** -DIGITS
    may = rest >= np.repeat(least, np.diff(at)) - 1e-9 * sums[-1] / max(1, len(up))
    number = np.add.reduceat(may, at[:-1]) if len(terms) else np.zeros(len(at) - 1, int)
    total, spare = np.zeros(own.n), np.empty(own.n)
    for q in np.flatnonzero(number).tolist():
        ts, ws = terms[at[q] : at[q + 1]].tolist(), weights[at[q] : at[q + 1]].tolist()
        n = int(number[q])
        if sum(own.df[ts[:n]]) > own.n // 2:
            for t, w in zip(ts, ws):
                if t in own.whole:
                    np.multiply(own.whole[t], w, out=spare)
                    np.add(total, spare, out=total)
                else:
                    r, v = own.of(t)
                    total[r] += w * v
            found = np.flatnonzero(total >= max(least[q], 1e-300))
            scores = total[found]
            total[:] = 0
        else:
            found = np.unique(np.concatenate([own.of(t)[0] for t in ts[:n]]))
            if not len(found):
                continue
            touched = [found]
            for i, (t, w) in enumerate(zip(ts, ws)):
                if t in own.whole and i >= n:
                    total[found] += w * own.whole[t][found]
                else:
                    r, v = own.of(t)
                    total[r] += w * v
                    touched.append(r)
            scores = total[found]
            for r in touched:
                total[r] = 0
            keep = scores >= max(least[q], 1e-300)
            found, scores = found[keep], scores[keep]
        scores = np.round(scores, DIGITS)
        keep = (scores >= best.least[q]) & (scores > 0)
        if keep.any():
            best.offer(q, keys[found[keep]], scores[keep])


def _scored_in_tasks(chunks: DataFrame, sets: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """sets: (terms array<struct<w, token>>, ids): queries of equal terms; w is the negative weight."""
    asked = sets.select(F.transform("terms", lambda x: x["token"]).alias("tokens"), F.transform("terms", lambda x: -x["w"]).alias("w"), "ids").toArrow().combine_chunks()
    flat = lambda c, kind: pa.concat_arrays([*(x.flatten() for x in asked.column(c).chunks), pa.array([], kind)])
    sizes = lambda c: np.array([n for x in asked.column(c).chunks for n in x.value_lengths().to_pylist()], np.int64)
    tokens = flat("tokens", pa.string()).dictionary_encode()
    place = {t: i for i, t in enumerate(tokens.dictionary.to_pylist())}
    terms, weights = tokens.indices.to_numpy().astype(np.int64), flat("w", pa.float64()).to_numpy()
    at = np.concatenate(([0], np.cumsum(sizes("tokens"))))
    ids, of = flat("ids", pa.string()), np.repeat(np.arange(len(asked)), sizes("ids"))

    def run(batches):
        best, keys, texts, block = Best(len(at) - 1, k), [], [], FIRST

        def flush():
            _score_block(Postings(texts, place), np.array([*keys, None], object)[:-1], best, at, terms, weights)
            keys.clear()
            texts.clear()

        for batch in batches if len(of) else ():
            keys += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            if len(keys) >= block:
                flush()
                block = TEXTS
        if keys:
            flush()
        yield from best.batches(kind)

    kind = {"string": pa.string(), "int": pa.int32()}.get(chunks.schema[key].dataType.simpleString(), pa.int64())
    rows = chunks.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull())
    found = few_parts(rows).mapInArrow(run, f"q int, key {chunks.schema[key].dataType.simpleString()}, score double")
    return numbered_queries(found, ids, of, k, key)


def checked_weights(weights: dict[int, float] | list[float] | None, sources: int | None = None) -> dict[int, float] | None:
    """Weights by source. A list has one for each source in order, and as many as there are sources; none at all means 1."""
    if weights is None:
        return None
    if sources is not None and len(weights) != sources:
        raise ValueError(f"{len(weights)} weights for {sources} sources")
    own = dict(weights) if isinstance(weights, dict) else dict(enumerate(weights))
    if any(not isinstance(w, (int, float)) or w != w for w in own.values()):
        raise ValueError(f"weights must be numbers: {own}")
    return own


def fuse(rankings: DataFrame, method: str, weights: dict[int, float] | list[float] | None = None, k0: int = 60, sources: int | None = None) -> DataFrame:
    """(query_id, rank, item, score). method: combsum, combmnz or rrf. A query with one source keeps its ranking and
    scores, weight or none. Equal scores: by the first source that has the item, then by rank there. Where weights are
    given, a source without one is an error: of the call if ``sources`` says how many there are, else of the running query."""
    w: Column = F.lit(1.0)
    if (own := checked_weights(weights, sources)) is not None:
        known = F.create_map(*[F.lit(x) for kv in own.items() for x in (int(kv[0]), float(kv[1]))]) if own else F.create_map().cast("map<int,double>")
        w = F.coalesce(F.try_element_at(known, F.col("source").cast("int")), F.raise_error(F.concat(F.lit("no weight for source "), F.col("source").cast("string"))).cast("double"))
    terms = {"combsum": F.sum(w * F.col("score")), "combmnz": F.sum(w * F.col("score")) * F.count_if(F.col("score") > 0), "rrf": F.sum(w / (k0 + F.col("rank")))}
    if method not in terms:
        raise ValueError(f"unknown fusion: {method}")
    counted = rankings.withColumn("_n", F.size(F.collect_set("source").over(Window.partitionBy("query_id"))))
    fused = counted.groupBy("query_id", "item").agg(terms[method].alias("sum"), F.first("_n").alias("_n"), F.min(F.struct("source", "rank")).alias("first"), F.max("score").alias("single"))
    scored = fused.select("query_id", "item", F.round(F.when(F.col("_n") == 1, F.col("single")).otherwise(F.col("sum")), DIGITS).alias("score"), "first", "_n")
    order = [F.when(F.col("_n") == 1, F.col("first.rank")).otherwise(F.lit(0)), F.desc("score"), F.col("first.source"), F.col("first.rank"), F.col("item")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint")).select("query_id", "rank", "item", "score")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds."""
    return T.let(F.array_distinct(T.tokens(query)), lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, T.tokens(text))) / F.size(q), DIGITS)))


def rerank(candidates: DataFrame, most: int) -> DataFrame:
    """candidates: (query_id, rank, item, query, text). The first ``most`` of each query ordered by overlap; the tail is
    dropped, ties keep their order. Any column expression or pandas UDF of (query, text) can stand in for overlap."""
    scored = candidates.filter(F.col("rank") <= most).withColumn("score", overlap(F.col("query"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.select("query_id", F.row_number().over(w).cast("bigint").alias("new_rank"), "item", "score").withColumnRenamed("new_rank", "rank")


def documents_of(scored: DataFrame, method: str, top_n: int = 3, k_chunks: int = 30) -> DataFrame:
    """scored: (query_id, rank, doc_id, score). (query_id, rank, doc_id, score) by max_pool, sum or weighted_mean over a
    query's first ``k_chunks`` chunks; the mean weighs a document's i-th chunk by 1 / i. Ties: first appearance."""
    first = scored.filter(F.col("rank") <= k_chunks).withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")))
    values = {"max_pool": F.max("score"), "sum": F.sum("score"), "weighted_mean": F.sum(F.col("score") / F.col("_i")) / F.sum(1.0 / F.col("_i"))}
    if method not in values:
        raise ValueError(f"unknown aggregation: {method}")
    docs = first.groupBy("query_id", "doc_id").agg(F.round(values[method], DIGITS).alias("score"), F.min("rank").alias("_first"))
    return top(docs, top_n, ["query_id"], [F.desc("score"), F.asc("_first"), F.asc("doc_id")]).select("query_id", "rank", "doc_id", "score")


def centroids(hits: DataFrame, vectors: DataFrame, doc: str, key: str = "vec_id", vector: str = "embedding", most: int = 5) -> DataFrame:
    """hits: (query_id, rank, key). (query_id, doc, centroid): unit mean of a document's first ``most`` retrieved vectors.
    Computed per query, so no query depends on another."""
    own = hits.join(vectors.select(key, F.col(doc), F.col(vector).cast("array<double>").alias("v")), key)
    first = top(own, most, ["query_id", doc], [F.asc("rank")], "_i")
    parts = first.select("query_id", doc, F.posexplode("v").alias("d", "x")).groupBy("query_id", doc, "d").agg(F.avg("x").alias("x"))
    return parts.groupBy("query_id", doc).agg(unit(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"])).alias("centroid"))


def diverse(docs: DataFrame, doc: str, n: int = 3, threshold: float = 0.92, pool: int = 18) -> DataFrame:
    """docs: (query_id, rank, doc, centroid). Greedy by rank over the first ``pool``: a document too close to a chosen one
    is passed over; passed-over ones fill up what is missing. (query_id, rank, doc)."""
    rows = docs.filter(F.col("rank") <= pool).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(doc).alias("doc"), "centroid"))).alias("c"))
    empty = F.filter("c", lambda x: F.lit(False))

    def cosine(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc["chosen"], lambda y: F.coalesce(cosine(x["centroid"], y["centroid"]) >= threshold, F.lit(False)))
        take = (F.size(acc["chosen"]) < n) & ~near
        return F.struct(F.when(take, F.array_append(acc["chosen"], x)).otherwise(acc["chosen"]).alias("chosen"), F.when(take, acc["passed"]).otherwise(F.array_append(acc["passed"], x)).alias("passed"))

    picked = rows.select("query_id", F.aggregate("c", F.struct(empty.alias("chosen"), empty.alias("passed")), step, lambda acc: F.slice(F.concat(acc["chosen"], acc["passed"]), 1, n)).alias("c"))
    return picked.select("query_id", F.posexplode("c").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.doc").alias(doc))


def fragments_of(ranked: DataFrame, n: int = 10, words: int = 250, least: int = 20) -> DataFrame:
    """ranked: (query_id, rank, chunk_id, doc_id, text). (query_id, rank, chunk_id, doc_id, text): parts of at most
    ``words`` words, without repeats (case and white space apart), well-formed ones of ``least`` words first, others only
    to fill up to n."""
    sized = ranked.select("query_id", "rank", "chunk_id", "doc_id", "text", T.word_count("text").alias("_w"))
    whole = sized.filter(F.col("_w") <= words).select("query_id", "rank", "chunk_id", "doc_id", F.lit(0).alias("part"), T.strip("text").alias("text"))
    # a chunk that many queries find is divided once
    long = sized.filter(F.col("_w") > words).withColumn("_h", F.xxhash64("text"))
    divided = long.select("chunk_id", "_h", "text").distinct().select("chunk_id", "_h", F.posexplode(output_parts(F.col("text"), words)).alias("part", "text"))
    cut_up = long.drop("text").join(divided, ["chunk_id", "_h"]).select("query_id", "rank", "chunk_id", "doc_id", "part", "text")
    parts = whole.unionByName(cut_up).filter(F.col("text") != "")
    keyed = parts.withColumn("_k", F.xxhash64(F.array_join(T.words(F.lower("text")), " ")))
    first = top(keyed, 1, ["query_id", "_k"], [F.asc("rank"), F.asc("part"), F.asc("chunk_id")], "_i")
    order = [((T.word_count("text") < least) | ~T.well_formed("text")).asc(), F.asc("rank"), F.asc("part"), F.asc("chunk_id")]
    return top(first, n, ["query_id"], order, "place").select("query_id", F.col("place").alias("rank"), "chunk_id", "doc_id", "text")

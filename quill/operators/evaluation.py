"""Retrieval metrics, leaderboards, checks of results and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quill.functions import text as T
from quill.operators.ordinals import with_ordinal
from quill.operators.ranking import DIGITS, top

#: What a result must hold.
DOCUMENTS, FRAGMENTS, WORDS = 3, 10, 250
CATEGORIES = (1, 2, 3)
PREFIX = 120


def dcg(graded: DataFrame, k: int = 10, by: str = "query_id") -> DataFrame:
    """graded: (by, rank, grade). (by, dcg)."""
    return graded.groupBy(by).agg(F.round(F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1))), F.lit(0.0)), DIGITS).alias("dcg"))


def ideal(pool: DataFrame, k: int = 10, by: str = "query_id") -> DataFrame:
    """pool: (by, grade, n): n items of that grade. DCG of the best order; grades are spread only as far as k."""
    w = Window.partitionBy(by).orderBy(F.desc("grade"), F.desc("n"))
    placed = pool.filter("grade > 0 AND n > 0").withColumn("_to", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("n"))
    ranks = placed.filter(F.col("_from") < k).select(by, "grade", F.explode(F.sequence(F.col("_from") + 1, F.least("_to", F.lit(k)))).alias("rank"))
    return ranks.groupBy(by).agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("ideal"))


def ndcg(graded: DataFrame, pool: DataFrame, k: int = 10, by: str = "query_id") -> DataFrame:
    """(by, ndcg); 0 where the ideal is 0."""
    got = graded.filter(F.col("rank") <= k).groupBy(by).agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("got"))
    return got.join(ideal(pool, k, by), by, "left").select(by, F.round(F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.col("got") / F.col("ideal")).otherwise(0.0), DIGITS).alias("ndcg"))


def f1_at_3(retrieved: DataFrame, relevant: DataFrame, by: str = "query_id", item: str = "item") -> DataFrame:
    """(by, f1): precision over 3, recall over at most 3 relevant; distinct items; 0 without relevant ones."""
    r, g = retrieved.select(by, item).distinct(), relevant.select(by, item).distinct()
    hits = r.join(g, [by, item]).groupBy(by).agg(F.count("*").alias("h"))
    sizes = g.groupBy(by).agg(F.count("*").alias("n"))
    p, rec = F.col("h") / 3.0, F.col("h") / F.least("n", F.lit(3))
    return r.select(by).distinct().join(sizes, by, "left").join(hits, by, "left").select(by, F.round(F.when(F.coalesce("h", F.lit(0)) > 0, 2 * p * rec / (p + rec)).otherwise(0.0), DIGITS).alias("f1"))


def competition_rank(scores: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """scores with rank: 1 the best, equal scores share the best place."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(*(by or [])).orderBy(F.desc(score))).cast("bigint"))


def borda_points(scores: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """scores with points: participants minus place."""
    ranked = competition_rank(scores, score, by)
    return ranked.withColumn("points", F.count("*").over(Window.partitionBy(*(by or []))) - F.col("rank"))


def borda_leaderboard(a: DataFrame, b: DataFrame, team: str, first: str, second: str) -> DataFrame:
    """Teams of both tables, a missing score counts 0; points of both metrics added; ordered by total, first metric, name."""
    both = a.join(b, team, "full").select(team, F.coalesce(first, F.lit(0.0)).alias(first), F.coalesce(second, F.lit(0.0)).alias(second))
    p = borda_points(both, first).drop("rank").withColumnRenamed("points", "p1")
    q = borda_points(p, second).drop("rank").withColumnRenamed("points", "p2").withColumn("total", F.col("p1") + F.col("p2"))
    return q.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), F.desc(first), team)).cast("bigint"))


def weak_labels(manifest: DataFrame) -> DataFrame:
    """(query_id, query, fuente, grade): grade 3, 2 or 1 by rank, the best of repeated rows; queries numbered in order."""
    grade = F.when(F.col("rank_en_query") <= 2, 3).when(F.col("rank_en_query") <= 4, 2).otherwise(1)
    best = manifest.groupBy("query", "fuente").agg(F.max(grade).alias("grade"))
    number = with_ordinal(best.select("query").distinct(), ["query"], "n", 1)
    return best.join(number, "query").select(F.format_string("q%03d", "n").alias("query_id"), "query", "fuente", F.col("grade").cast("bigint").alias("grade"))


def messages(*checks: tuple[Column, Column]) -> Column:
    """Array of the messages whose condition holds."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks]), lambda x: x.isNotNull())


def chunk_errors(chunks: DataFrame, required: list[str]) -> DataFrame:
    """(chunk_id, error): one row for each violated rule of a chunk row."""
    rules = [(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    rules += [(~F.col("fenomeno").isin(*CATEGORIES), F.concat(F.lit("bad fenomeno "), F.col("fenomeno").cast("string"))), (F.col("posicion") < 0, F.lit("bad posicion"))]
    return chunks.select("chunk_id", F.explode(messages(*rules)).alias("error"))


def result_errors(results: DataFrame) -> DataFrame:
    """results: (query_id, documents, fragments). (query_id, error) for each violated rule; a missing list has size 0."""
    d, f = F.coalesce(F.size("documents"), F.lit(0)), F.coalesce(F.size("fragments"), F.lit(0))
    rules = messages(
        (F.col("query_id").isNull(), F.lit("missing query_id")),
        (d != DOCUMENTS, F.concat(F.lit("documents: "), d.cast("string"))),
        (f != FRAGMENTS, F.concat(F.lit("fragments: "), f.cast("string"))),
        (F.exists("documents", lambda x: x["rank"].isNull() | x["doc_id"].isNull()), F.lit("incomplete document")),
        (F.exists("fragments", lambda x: x["rank"].isNull() | x["chunk_id"].isNull() | x["doc_id"].isNull() | x["text"].isNull()), F.lit("incomplete fragment")),
        (F.exists("fragments", lambda x: T.word_count(x["text"]) > WORDS), F.lit("fragment too long")),
    )
    return results.select("query_id", F.explode(rules).alias("error"))


def sequence_errors(queries: DataFrame, key: str = "query_id", pattern: str = "q%03d") -> DataFrame:
    """(line, expected, found): rows in order of their key whose key is not the one expected at that place."""
    lines = with_ordinal(queries.select(key).distinct(), [key], "line", 1)
    return lines.select("line", F.format_string(pattern, "line").alias("expected"), F.col(key).alias("found")).filter("expected <> found")


def omnipresent(cited: DataFrame, most: int = 5, flag: int = 10) -> DataFrame:
    counts = cited.groupBy("doc_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "doc_id").limit(most).withColumn("flagged", F.col("n") >= flag)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: (query_id, docs array, texts array). Per query: common documents and fragment prefixes, and equality."""
    prefixes = lambda c: F.array_distinct(F.transform(c, lambda t: F.substring(t, 1, PREFIX)))
    both = a.alias("a").join(b.alias("b"), "query_id")
    common_d = F.size(F.array_intersect("a.docs", "b.docs"))
    fa, fb = prefixes(F.col("a.texts")), prefixes(F.col("b.texts"))
    return both.select(
        "query_id",
        common_d.cast("bigint").alias("common_docs"),
        F.size(F.array_intersect(fa, fb)).cast("bigint").alias("common_fragments"),
        (F.col("a.docs") == F.col("b.docs")).alias("same_docs"),
        ((F.size(F.array_except(fa, fb)) == 0) & (F.size(F.array_except(fb, fa)) == 0)).alias("same_fragments"),
        ((common_d < F.size("a.docs")) | (F.size(F.array_intersect(fa, fb)) < F.size(fa))).alias("changed"),
    )


def best_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top(df, 1, by, order, "_n").drop("_n")

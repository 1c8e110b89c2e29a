"""Entity co-occurrence graph: mentions, edges, pruning, linking and scoring of chunks.

Entities come from any recogniser that gives (chunk_id, pos, name, score); the default takes runs of capitalised words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quill.functions import text as T
from quill.operators.joins import join_checked
from quill.operators.ranking import DIGITS, QUERIES, Best, few_parts, numbered_queries, top
from quill.session import cut, written

#: Entities a chunk, evidence a node, least length of a name and of a partial match.
PER_CHUNK, EVIDENCE, MIN_NAME, MIN_PARTIAL = 8, 21, 3, 4
#: Units of a score of 1, neighbours of seeds sent to every task, and chunks and sums of a block there.
UNITS, NEAR, BLOCK, CELLS = 20, 4_000_000, 8192, 25_000_000
TRIM = " .,;:\"'()[]"
NAME = r"\p{Lu}[\p{L}\p{M}]+(?:[ -]\p{Lu}[\p{L}\p{M}]+)*"


def normal_name(name: str | Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(T.lit_or_col(name), r"(?U)\s+", " "), F.lit(TRIM)))


def names(text: str | Column) -> Column:
    """Runs of capitalised words, in order."""
    return F.regexp_extract_all(T.lit_or_col(text), F.lit(NAME), F.lit(0))


def recognised(chunks: DataFrame, key: str = "chunk_id", text: str = "texto") -> DataFrame:
    """(key, pos, name, score): runs of capitalised words of the whole text, in order; score is the length."""
    found = chunks.select(key, F.posexplode(names(text)).alias("pos", "name"))
    return found.withColumn("score", F.length("name"))


def simple_edges(mentions: DataFrame) -> DataFrame:
    """(src, dst, peso, chunk_id): a directed edge for each ordered pair of mentions of a chunk, repeated names included;
    the first chunk is kept as evidence. Mentions a chunk are few (PER_CHUNK), so pairs are made within the row."""
    lists = mentions.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("m"))
    pairs = lists.select("chunk_id", F.explode(F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a["name"].alias("src"), b["name"].alias("dst")))))).alias("e"))
    return pairs.groupBy("e.src", "e.dst").agg(F.count("*").alias("peso"), F.min("chunk_id").alias("chunk_id"))


def best_mentions(found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, pos, name): a chunk's best PER_CHUNK entities, normalised, long enough, each name once; pos is the order by
    score."""
    best = top(found, PER_CHUNK, [key], [F.desc("score"), F.asc("pos")], "place")
    named = best.select(key, F.col("place").alias("pos"), normal_name("name").alias("name")).filter(F.length("name") >= MIN_NAME)
    return named.groupBy(key, "name").agg(F.min("pos").alias("pos")).select(key, "pos", "name")


def nodes(mentions: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(name, chunks): up to EVIDENCE chunks of each name, the first in order. A name of a third of all chunks is bounded
    by the rank filter before its chunks are collected."""
    return top(mentions.select("name", key).distinct(), EVIDENCE, ["name"], [F.asc(key)], "_n").groupBy("name").agg(F.sort_array(F.collect_list(key)).alias("chunks"))


def pruned(edges: DataFrame, least: int = 2) -> DataFrame:
    return edges.filter(F.col("peso") >= least)


def with_edges(node: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return node.join(ends, "name", "left_semi")


def linked(asked: DataFrame, node: DataFrame) -> DataFrame:
    """asked: (query_id, key). (query_id, key, name): the node of equal name, else of the names that hold the key or are
    held by it between word borders (first occurrence), the nearest in length, then the first by name.

    Partial matches need no theta join: word borders make the shorter name a run of whole words of the longer one, so both
    sides are joined on the runs of words of each, which are at most the square of a name's words.
    """
    asked = cut(asked.filter(F.col("key") != "").distinct())
    names = node.select("name")
    exact = asked.join(names.withColumn("key", F.col("name")), "key").select("query_id", "key", "name")
    rest = asked.join(names.select(F.col("name").alias("key")), "key", "left_anti").filter(F.length("key") >= MIN_PARTIAL)

    def runs(c: str) -> Column:
        w = F.filter(F.split(F.col(c), r"(?U)(?<![\p{L}\p{N}])|(?![\p{L}\p{N}])"), lambda x: x != "")
        return T.let(w, lambda own: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.transform(F.sequence(F.lit(1), F.size(own) - i + 1), lambda n: F.array_join(F.slice(own, i, n), ""))))))

    held = rest.join(names.select("name", F.explode(runs("name")).alias("key")), "key").filter(F.col("key") != F.col("name"))
    holding = rest.select("query_id", "key", F.explode(runs("key")).alias("name")).filter(F.col("name") != F.col("key")).join(names, "name")
    both = held.select("query_id", "key", "name").unionByName(holding.select("query_id", "key", "name")).distinct()
    # the first occurrence must lie between word borders
    short, long = F.when(F.length("key") <= F.length("name"), F.col("key")).otherwise(F.col("name")), F.when(F.length("key") <= F.length("name"), F.col("name")).otherwise(F.col("key"))
    at = F.expr("instr(_l, _s)")
    placed = both.withColumn("_s", short).withColumn("_l", long).withColumn("_i", at)
    before, after = F.expr("substring(_l, _i - 1, 1)"), F.expr("substring(_l, _i + length(_s), 1)")
    fits = placed.filter((F.col("_i") > 0) & ((F.col("_i") == 1) | ~before.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]"))
    best = top(fits, 1, ["query_id", "key"], [F.asc(F.abs(F.length("name") - F.length("key"))), F.asc("name")], "_n").select("query_id", "key", "name")
    return exact.unionByName(best)


def graph_top(seeds: DataFrame, node: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """seeds: (query_id, name); node: (name, chunk_id) of all mentions, or (name, chunks). (query_id, rank, chunk_id, score):
    1 for each chunk of a seed, and for each chunk of a neighbour half of peso / 10 + 0.1 of the edge from the seed, else of
    the edge to it.

    Every chunk of every neighbour counts, which are far too many rows to be made: each task takes its chunks with the
    names in them, adds up what each seed gives to each chunk of a block, and passes on the k best of each query. Scores are
    counted in units of 0.05, so that they are whole numbers. Queries of equal seeds are one; more than NEAR neighbours go
    in groups of queries.
    """
    seeds = cut(seeds.distinct())
    places = node if "chunk_id" in node.columns else node.select("name", F.explode("chunks").alias("chunk_id"))
    own = cut(seeds.select("name").distinct())
    forth = edges.select(F.col("src").alias("name"), F.col("dst").alias("other"), F.col("peso").alias("out"))
    back = edges.select(F.col("dst").alias("name"), F.col("src").alias("other"), F.col("peso").alias("in"))
    near = join_checked(forth, own, ["name"]).join(join_checked(back, own, ["name"]), ["name", "other"], "full").select("name", "other", (F.coalesce("out", "in") + 1).alias("units"))
    near = written(near.unionByName(own.select("name", F.col("name").alias("other"), F.lit(UNITS).cast("bigint").alias("units"))), "near")
    counts = near.groupBy("name").agg(F.count("*").alias("n"))
    asked = seeds.join(counts, "name").groupBy("query_id").agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("n").alias("n"))
    sets = cut(asked.groupBy("names").agg(F.collect_list("query_id").alias("ids"), F.max("n").alias("n")))
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, -(-count // QUERIES), 1 if near.count() <= NEAR else -(-total // NEAR))
    sets = sets.withColumn("g", F.pmod(F.xxhash64("names"), F.lit(groups)))
    wanted = near.select(F.col("other").alias("name")).distinct()
    held = join_checked(places, cut(wanted), ["name"], "left_semi").groupBy("chunk_id").agg(F.collect_set("name").alias("names"))
    held = written(held, "held") if groups > 1 else held
    out = None
    for g in range(groups):
        mine = sets.filter(F.col("g") == g)
        part = _summed_in_tasks(held, mine, near, k)
        out = part if out is None else out.unionByName(part)
    return out


def _summed_in_tasks(held: DataFrame, sets: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """held: (chunk_id, names); sets: (names, ids): queries of equal seeds; near: (name, other, units)."""
    asked = sets.select("names", "ids").toArrow()
    lists, ids = asked.column("names").to_pylist(), asked.column("ids").combine_chunks()
    seeds = sorted({n for x in lists for n in x})
    number = {n: i for i, n in enumerate(seeds)}
    of = np.repeat(np.arange(len(lists)), [len(x) for x in ids.to_pylist()]).astype(np.int64)
    # rows of equal numbers of seeds are added up at once
    sizes = np.array([len(x) for x in lists], np.int64)
    by_size = {int(n): (np.flatnonzero(sizes == n), np.array([[number[x] for x in lists[i]] for i in np.flatnonzero(sizes == n)], np.int64)) for n in np.unique(sizes)}
    spark = held.sparkSession
    chosen = cut(spark.createDataFrame(pa.table({"name": pa.array(seeds, pa.string())})))
    rows = join_checked(near, chosen, ["name"], "left_semi").groupBy("name").agg(F.collect_list("other").alias("others"), F.collect_list("units").alias("units")).toArrow()
    others = pa.concat_arrays([*(x.flatten() for x in rows.column("others").chunks), pa.array([], pa.string())]).dictionary_encode()
    place = {n: i for i, n in enumerate(others.dictionary.to_pylist())}
    to, units = others.indices.to_numpy().astype(np.int32), np.concatenate([*(x.flatten().to_numpy() for x in rows.column("units").chunks), np.zeros(0, np.int64)]).astype(np.int32)
    ends = np.cumsum([0, *(n for x in rows.column("others").chunks for n in x.value_lengths().to_pylist())])
    at = {n: i for i, n in enumerate(rows.column("name").to_pylist())}
    ranges = [(int(ends[at[n]]), int(ends[at[n] + 1])) for n in seeds]
    key_kind, block = pa.string(), max(1, min(BLOCK, CELLS // max(1, len(seeds))))

    def gains(names: list[list[str]]) -> np.ndarray:
        """(seeds, chunks): units that each seed gives to each chunk."""
        found = [place.get(x, -1) for own in names for x in own]
        name, chunk = np.array(found, np.int64), np.repeat(np.arange(len(names)), [len(x) for x in names])
        name, chunk = name[name >= 0], chunk[name >= 0]
        order = np.argsort(name, kind="stable")
        chunk = chunk[order]
        starts = np.searchsorted(name[order], np.arange(len(place) + 1))
        many = np.diff(starts)
        out = np.zeros((len(seeds), len(names)), np.int32)
        for i, (a, b) in enumerate(ranges):
            t = to[a:b]
            n = many[t]
            t, n, u = t[n > 0], n[n > 0], units[a:b][n > 0]
            if len(t):
                where = np.arange(n.sum()) + np.repeat(starts[t] - np.cumsum(n) + n, n)
                out[i] = np.bincount(chunk[where], np.repeat(u, n), len(names))
        return out

    def run(batches):
        best, keys, names = Best(len(lists), k), [], []

        def flush():
            v, own = gains(names), np.array(keys, object)
            most = v.max(1)
            for rows_, cols in by_size.values():
                may = np.flatnonzero(most[cols].sum(1) >= np.maximum(best.least[rows_], 1))
                for first in range(0, len(may), 64):
                    some = may[first : first + 64]
                    s = v[cols[some, 0]]
                    for c in range(1, cols.shape[1]):
                        s = s + v[cols[some, c]]
                    q, at_ = np.nonzero(s >= np.maximum(best.least[rows_[some]], 1)[:, None])
                    cuts = np.flatnonzero(np.diff(q, prepend=-1))
                    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q)]):
                        best.offer(int(rows_[some[q[x]]]), own[at_[x:y]], s[q[x], at_[x:y]].astype(float))
            keys.clear()
            names.clear()

        for batch in batches if lists else ():
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                keys += part.column(0).to_pylist()
                names += part.column(1).to_pylist()
                if len(keys) >= block:
                    flush()
        if keys:
            flush()
        for batch in best.batches(key_kind):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(batch.column(2).to_numpy() / UNITS, DIGITS))], ["q", "key", "score"])

    found = few_parts(held.select(F.col("chunk_id").cast("string").alias("key"), "names")).mapInArrow(run, "q int, key string, score double")
    return numbered_queries(found, ids.flatten(), of, k, "chunk_id")

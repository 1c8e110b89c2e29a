"""Approximate vector search by cells: every vector is indexed under its nearest centre, queries look into the nearest cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quill.operators.ranking import DIGITS, QUERIES, top

#: Vectors to which the centres are fitted, and queries on which the number of cells to look into is measured, at most; every
#: vector is indexed.
SAMPLE, TRIED = 20_000, 200
#: Fewest and most cells; between them the square root of the number of vectors. Part of the true neighbours that must be
#: found in the sample.
CELLS, MOST_CELLS, RECALL, ROUNDS = 16, 4096, 0.95, 12


@dataclass
class Fitted:
    """Centres of the cells, and how many of the nearest a query looks into."""

    centres: np.ndarray
    probes: int


def nearness(c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each vector (rows) how near each centre is."""
    return v @ c.T - 0.5 * (c * c).sum(1)


def fit(vectors: DataFrame, k: int = 10, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> Fitted:
    """Centres by k-means over the ``sample`` vectors first by a hash of their key, as many as the square root of the number of
    vectors; and the fewest cells in which the sample's own queries find RECALL of their k nearest. Clustered vectors need
    few of the cells, vectors without clusters most of them."""
    present = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    cells = cells or min(MOST_CELLS, max(CELLS, math.isqrt(present.count())))
    rows = present.orderBy(F.xxhash64(key), key).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    if len(v) <= cells:
        return Fitted(v, len(v))
    c = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)]
    for _ in range(ROUNDS):
        near = nearness(c, v).argmax(1)
        c = np.array([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(cells)])
    of, asked = nearness(c, v).argmax(1), v[:TRIED]
    best = np.argsort(-(asked @ v.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-nearness(c, asked), axis=1), axis=1)  # of each cell among a query's nearest
    needed = np.sort(np.take_along_axis(place, of[best], 1).ravel())
    return Fitted(c, int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))]) + 1)


def index(vectors: DataFrame, fitted: Fitted, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(cell int, key, vector array<double>): lay it out by cell to read only the cells asked for."""
    kind, centres = vectors.schema[key].dataType.simpleString(), fitted.centres

    def run(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = nearness(centres, v).argmax(1) if len(centres) else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1)], ["cell", "key", "v"])

    present = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) == (centres.shape[1] if len(centres) else -1)))
    return present.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"cell int, key {kind}, v array<double>").select("cell", F.col("key").alias(key), F.col("v").alias(vector))


def approximate_top(indexed: DataFrame, fitted: Fitted, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k best of each query among the vectors of its nearest cells, as many as were
    fitted or ``probes``. Queries are sent to the tasks; more than QUERIES are an error, to be asked in parts."""
    if queries.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"more than {QUERIES} queries at once")
    probes, fitted = probes or fitted.probes, fitted.centres
    kind = indexed.schema[key].dataType.simpleString()
    asked = queries.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).toArrow()
    ids, n = asked.column("key").combine_chunks(), len(asked)
    q = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
    near = np.argsort(-nearness(fitted, q), axis=1)[:, :probes] if n and len(fitted) else np.zeros((0, 0), int)
    of_cell = {c: np.flatnonzero((near == c).any(1)) for c in range(len(fitted))}
    wanted = [c for c, x in of_cell.items() if len(x)]

    def run(batches):
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for c in np.unique(cells).tolist():
                rows, who = np.flatnonzero(cells == c), of_cell[c]
                rows = rows[np.argsort(keys[rows], kind="stable")]
                s = np.round(q[who] @ v[rows].T, DIGITS) + 0.0
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                which = np.repeat(who, best.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), batch.column(1).take(pa.array(rows[best].ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())], ["query_id", "key", "score"])

    part = indexed.filter(F.col("cell").isin(wanted)).select("cell", F.col(key).alias("key"), F.col(vector).alias("v"))
    found = part.mapInArrow(run, f"query_id {kind}, key {kind}, score double")
    return top(found, k, ["query_id"], [F.desc("score"), F.asc("key")]).select("query_id", "rank", F.col("key").alias(key), "score")

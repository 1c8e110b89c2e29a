"""Lines repeated across the documents of one source.

Lines are compared by a key without letter case, white space and digits. Per source, the keys of high support are the
nodes of a graph and pairs of consecutive lines its weighted edges; edges of high support join nodes to boilerplate
blocks (connected components). A component is a block if a line of enough letters is in it, which is so for every such line
by itself; short lines (a date, "Share", a rule) belong to a block only by edges of high support. Occurrences of a block
are its long lines anywhere and its short ones beside another line of the block; these are deleted.

Scale: a document's keys are made distinct within the row, so that counting is one partially aggregated shuffle of
(source, 64-bit key). A key of support 10 % stands in a tenth of the documents, so a source has at most ten times as
many nodes as a document has lines on average: nodes and edges of a source fit one row whatever its size.

Defined results: documents with null source or null, empty or blank text have no repeated lines and keep their text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quill.functions import text as T
from quill.operators.joins import join_checked
from quill.session import cut, written

MIN_LETTERS = 10
MIN_DOCUMENTS = 3
MIN_SHARE = 0.1


def line_key(line: Column) -> Column:
    """What is left of a line without case, white space and digits."""
    return F.regexp_replace(F.lower(line), r"[\s\x0B\x{85}\x{1C}-\x{1F}\p{Z}0-9]+", "")


def line_hashes(text: Column, letters: int) -> Column:
    """Array over the lines: 63 bits of hash of the key, and the lowest bit 1 for a line of enough letters; null for a
    line without key."""

    def one(line: Column) -> Column:
        return T.let(line_key(line), lambda key: F.when(key != "", F.xxhash64(key).bitwiseAND(~1).bitwiseOR(key.rlike(rf"(\p{{L}}\P{{L}}*){{{letters}}}").cast("bigint"))))

    return F.transform(F.split(text, "\n", -1), one)


def is_long(h: Column) -> Column:
    return h.bitwiseAND(1) == 1


def hashed(docs: DataFrame, key: str, text: str, source: str, letters: int = MIN_LETTERS) -> DataFrame:
    """(key, source, lines array<bigint>) of every document with a source, written once."""
    return written(docs.filter(F.col(source).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), line_hashes(F.col(text), letters).alias("lines")), "lines")


def supported(lines: DataFrame, share: float = MIN_SHARE, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(source, documents, nodes array<bigint>): keys of high support of each source that has any."""
    documents = lines.groupBy("source").agg(F.count("*").alias("documents"))
    keys = lines.select("source", F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("h"))
    counts = keys.groupBy("source", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # few per source are left; the sizes of the sources are as many rows as there are sources
    return cut(
        join_checked(counts, cut(documents), ["source"])
        .filter(F.col("n") >= F.lit(share) * F.col("documents"))
        .groupBy("source")
        .agg(F.first("documents").alias("documents"), F.sort_array(F.collect_list("h")).alias("nodes"))
    )


def blocks(lines: DataFrame, nodes: DataFrame, share: float = MIN_SHARE, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(source, node bigint, block int): connected components over edges of high support that hold a long line."""
    inside = F.filter("lines", lambda x: x.isNotNull())
    pairs = F.filter(
        F.zip_with(F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))), F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: F.array_contains("nodes", p["a"]) & F.array_contains("nodes", p["b"]) & (p["a"] != p["b"]),
    )
    found = join_checked(lines.filter(F.size("lines") > 1), nodes, ["source"])
    edges = found.select("source", "documents", F.explode(F.array_distinct(pairs)).alias("e")).groupBy("source", "documents", "e").agg(F.count("*").alias("n"))
    strong = edges.filter((F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("documents"))).groupBy("source").agg(F.collect_list("e").alias("edges"))
    graph = nodes.join(strong, "source", "left").select("source", "nodes", "edges")

    def components(frames):
        for frame in frames:
            out = []
            for source, own, joined in zip(frame["source"], frame["nodes"], frame["edges"]):
                parent = {int(n): int(n) for n in own}

                def root(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for e in joined if joined is not None else ():
                    a, b = root(int(e["a"])), root(int(e["b"]))
                    parent[max(a, b)] = min(a, b)
                number = {r: i for i, r in enumerate(sorted({root(n) for n in parent if n & 1}))}
                out += [(source, n, number[root(n)]) for n in parent if root(n) in number]
            yield pd.DataFrame(out, columns=["source", "node", "block"])

    return graph.mapInPandas(components, "source string, node bigint, block int")


def blocks_of(lines: DataFrame, share: float = MIN_SHARE, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(source, of map<bigint,int>): the block of each line of each source that has any."""
    found = blocks(lines, supported(lines, share, least), share, least)
    return cut(found.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("node", "block"))).alias("of")))


def occurrences(lines: Column, of: Column) -> Column:
    """array<struct<line_no, block, long>>: the lines that are occurrences of a block."""
    placed = F.filter(F.transform(lines, lambda h, i: F.struct(i.alias("line_no"), F.try_element_at(of, h).alias("block"), is_long(h).alias("long"))), lambda x: x["long"].isNotNull())

    def hits(own: Column) -> Column:
        beside = lambda x, k: F.coalesce(F.get(own, k)["block"] == x["block"], F.lit(False))
        return F.filter(own, lambda x, k: x["block"].isNotNull() & (x["long"] | beside(x, k - 1) | beside(x, k + 1)))

    return T.let(placed, hits)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = MIN_SHARE, least: int = MIN_DOCUMENTS, letters: int = MIN_LETTERS) -> DataFrame:
    """(key, line_no int, block int): occurrences of boilerplate blocks; of lines of too few letters none."""
    lines = hashed(docs, key, text, source, letters)
    hits = join_checked(lines.filter(F.size("lines") > 0), blocks_of(lines, share, least), ["source"])
    return hits.select(F.col("key").alias(key), F.explode(occurrences(F.col("lines"), F.col("of"))).alias("x")).filter("x.long").select(key, "x.line_no", "x.block")


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = MIN_SHARE, least: int = MIN_DOCUMENTS, letters: int = MIN_LETTERS) -> DataFrame:
    """(key, text, removed int): each document without the blocks of its source, their short lines included."""
    own = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    joined = join_checked(own, blocks_of(hashed(docs, key, text, source, letters), share, least), ["source"], "left")
    out = joined.withColumn("out", F.when(F.col("of").isNotNull() & (F.col("text") != ""), F.transform(occurrences(line_hashes(F.col("text"), letters), F.col("of")), lambda x: x["line_no"])))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("out", i)), "\n")
    some = F.coalesce(F.size("out"), F.lit(0)) > 0
    return out.select(F.col("key").alias(key), F.when(some, kept).otherwise(F.col("text")).alias("text"), F.when(some, F.size("out")).otherwise(0).alias("removed"))

"""Packing of items into containers of fixed capacity by hierarchical residual packing.

Each partition packs its own items by best fit in descending order and emits the nearly full containers. The underfull
ones are items again, and go up as counts: what a container holds is all that matters for packing it, so a node of the tree
is a histogram of loads, at most as many numbers as the capacity. Histograms of partitions are added up (Spark's partial
aggregation is the tree), best fit in descending order is repeated on the counts, and the resulting plan, a few ranges for
each load, gives every underfull container its place by its number among those of equal load. Nothing is left out however
many containers stay underfull, and no task holds more than its partition.

Defined results: an item of size 0 or null (an empty or null text) goes to a container of its partition and takes no room; an item
above the capacity is cut into full pieces and a rest, pieces counted from 0; equal rows are items of their own;
empty input gives no rows. Container names are unique and do not carry meaning.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quill.operators.joins import join_checked
from quill.session import cut, written

CAPACITY = 2048
#: Share of the capacity from which a container is final.
NEARLY_FULL = 0.995


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[np.ndarray, list[int]]:
    """(container of each item, load of each container): best fit over descending sizes, ties in given order."""
    sizes = np.asarray(sizes, np.int64)
    container = np.empty(len(sizes), np.int64)
    loads: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a container has exactly r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            c = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, c = capacity, len(loads)
            loads.append(0)
        container[i] = c
        loads[c] += size
        left = room - size
        by_room[left].append(c)
        open_rooms |= 1 << left
    return container, loads


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit in descending order over counts[load] equal items: (load, first, container, each) for ranges of items.

    Items of a load are numbered from 0; those of a range from ``first`` on fill containers from number ``container`` on, ``each``
    of them in one. A range ends where the next of its load begins. Equal containers are kept as one run, so the work grows with the runs (at most
    a few for each load), not with the items.
    """
    plan = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first container, containers)
    made = 0
    for load in sorted((x for x in counts if x > 0), reverse=True):
        left, at = counts[load], 0
        # taken before any is filled: a run filled by this load has no room for another item of it
        for room in sorted(r for r in runs if r >= load):
            for first, n in runs.pop(room):
                each = room // load
                full = min(n, left // each)
                if full:
                    plan.append((load, at, first, each))
                    at, left = at + full * each, left - full * each
                    runs.setdefault(room - each * load, []).append((first, full))
                if full < n and left:  # the last, partly filled container
                    plan.append((load, at, first + full, left))
                    runs.setdefault(room - left * load, []).append((first + full, 1))
                    at, left, full = at + left, 0, full + 1
                if full < n:
                    runs.setdefault(room, []).append((first + full, n - full))
            if not left:
                break
        if left:
            each = capacity // load
            n, rest = divmod(left, each)
            if n:
                plan.append((load, at, made, each))
                runs.setdefault(capacity - each * load, []).append((made, n))
                made, at = made + n, at + n * each
            if rest:
                plan.append((load, at, made, rest))
                runs.setdefault(capacity - rest * load, []).append((made, 1))
                made += 1
    return plan


FIELDS = "key string, piece int, start bigint, size bigint, slot int, bin int, load int, nth bigint"


def pack(items: DataFrame, key: str = "doc_id", size: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece int, start bigint, size bigint, container string): every item of (key, size) in a container."""
    kind = items.schema[key].dataType.simpleString()

    def local(frames):
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        whole = rows["size"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-whole // capacity))
        at = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        sizes = np.minimum(whole[at] - start, capacity)
        container, loads = np.zeros(len(at), np.int64), np.zeros(0, np.int64)
        some = sizes > 0
        if some.any():
            placed, held = best_fit(sizes[some], capacity)
            container[some], loads = placed, np.array(held)
        if not len(loads):
            loads = np.zeros(1, np.int64)
        done = loads >= NEARLY_FULL * capacity
        if (~some).any():  # items without size go to the fullest container, which is final
            full = int(np.argmax(loads))
            container[~some], done[full] = full, True
        # number of each underfull container among those of its load; -1 says final
        nth = np.full(len(loads), -1, np.int64)
        open_ = np.flatnonzero(~done)
        order = open_[np.argsort(loads[open_], kind="stable")]
        if len(order):
            begins = np.concatenate(([True], loads[order][1:] != loads[order][:-1]))
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
        yield pd.DataFrame({"key": rows["key"].to_numpy()[at], "piece": piece.astype(np.int32), "start": start, "size": sizes, "slot": np.int32(TaskContext.get().partitionId()), "bin": container.astype(np.int32), "load": loads[container].astype(np.int32), "nth": nth[container]})

    # keys travel as strings, which may be null
    first = items.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    table = written(first.mapInPandas(local, FIELDS), "packed")
    rest = table.filter("nth >= 0")
    # how many containers of each load a partition has, and how many the partitions before it have
    own = cut(rest.groupBy("load", "slot").agg((F.max("nth") + 1).alias("n")))
    counts = {r.load: r.n for r in own.groupBy("load").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan: dict[int, list] = defaultdict(list)
    for load, begin, container, each in best_fit_counts(counts, capacity):
        plan[load].append((begin, container, each))
    ranges = "array<struct<begin:bigint,container:bigint,each:bigint>>"
    plans = items.sparkSession.createDataFrame(sorted(plan.items()), f"load int, ranges {ranges}")
    before = own.select("load", "slot", (F.sum("n").over(Window.partitionBy("load").orderBy("slot")) - F.col("n")).alias("before"))
    placed = join_checked(join_checked(rest, cut(before), ["load", "slot"]), plans, ["load"]).withColumn("i", F.col("before") + F.col("nth"))
    found = F.array_max(F.filter("ranges", lambda r: r["begin"] <= F.col("i")))  # the last range that begins by then
    merged = placed.withColumn("r", found).withColumn("container", F.concat(F.lit("1-"), F.col("r.container") + F.floor((F.col("i") - F.col("r.begin")) / F.col("r.each"))))
    final = table.filter("nth < 0").withColumn("container", F.concat(F.lit("0-"), "slot", F.lit("-"), "bin"))
    columns = [F.col("key").cast(kind).alias(key), "piece", "start", "size", "container"]
    return final.select(*columns).unionByName(merged.select(*columns))


def fullness(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers that hold anything, what they hold, the fewest that could, and the share of their room in use."""
    loads = packed.groupBy("container").agg(F.sum("size").alias("load")).filter("load > 0")
    total = loads.agg(F.count("*").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("held"), F.coalesce(F.max("load"), F.lit(0)).alias("fullest"))
    return total.select("containers", "held", "fullest", F.ceil(F.col("held") / capacity).alias("fewest"), F.round(F.coalesce(F.col("held") / F.nullif(F.col("containers") * capacity, F.lit(0)), F.lit(1.0)), 6).alias("share"))

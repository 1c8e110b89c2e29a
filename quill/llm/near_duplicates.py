"""Groups of records that share most of their character 5-grams, by a binary trie self-join.

Every record gets 128 minima of its set of 5-grams (one-permutation hashing, empty bins filled from their neighbours)
and from these a sketch of 128 bits, one of each minimum: two records of similarity s differ in about a half of 1 - s of
the bits. Records are joined with themselves in a binary trie whose node pairs are traversed together, adding up differing
bits and dropping a pair of nodes once it exceeds the error budget. A budget of 31 bits prunes nothing in the first 31
levels, by which time every pair of records would have been visited; therefore the trie is entered through BANDS keys of
ROWS minima each, which must agree entirely: the trie proper lies below each key. Texts of few 5-grams, whose bins are
mostly copies, enter by all keys of an exact prefix filter and with a larger budget. Pairs that come out are compared
exactly.

Scale: the shuffle carries packed arrays of 40 bytes a record and band, no texts; keys have 64 bits and content ids 128, so
that unrelated records don't meet at any size. The number of parts follows from the number of records, so a task's share
stays the same however many there are. Equal texts have one content id and enter each bucket once. Keys that a sample of
the records shows to be very frequent are cut into groups of records before the shuffle, whose pairs are buckets of
their own; a bucket of more than HOT records is cut along the trie into blocks, whose pairs are spread over the
cluster; pairs are produced in bounded chunks. Texts are fetched for candidates only, those with very many partners in
slices. Chance to miss a pair of exactly 0.7: about 0.8 %; of 0.8: under 0.1 %.

Defined results: texts are lower-cased, white space is collapsed and trimmed; null texts and texts of fewer than five
code points have no 5-grams and so no pairs; rows of equal id are one record (of several texts the first in order counts).
Groups of more than WITHIN equal texts are listed as pairs with their first record, smaller ones in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quill.operators.joins import join_checked, join_hot
from quill.session import cut, written

GRAM = 5
THRESHOLD = 0.7
BINS = 128
BANDS, ROWS = 12, 3
BUDGET = 31
WITHIN = 64
#: Pairs of nodes of which the records are compared at once, and most pairs held at a time.
LEAF, CHUNK = 1024, 1 << 19
FLUSH = 40_000
#: Records of a bucket from which it is cut into blocks, whose pairs become tasks of their own.
HOT = 4096
#: Bytes of records that a task is to hold, and the share of the records by which very frequent keys are found.
PART_BYTES, SHARE = 32 << 20, 64
#: 5-grams up to which a text enters by the prefix filter, and the error budget there.
FEW, FEW_BUDGET = 57, 56
#: Pairs of texts compared at once.
COMPARED = 2000
RECORD = np.dtype([("key", "<u8"), ("hi", "<u8"), ("lo", "<u8"), ("a", "<u8"), ("b", "<u8")])
_EMPTY = np.uint32(0xFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower case, white space collapsed to single spaces and trimmed."""
    return " ".join(text.lower().split())


def content_id(tab: str | None, text: str) -> bytes:
    return hashlib.blake2b(f"{tab}\x1f{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 32-bit hashes."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def minima(texts: list[str]) -> np.ndarray:
    """(texts, BINS) minima of each normal text's 5-grams; every text has at least one gram."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(points) - GRAM + 1
    h = points[:n] * np.uint32(0x9E3779B1)
    for k in range(1, GRAM):
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B) + points[k : n + k]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[:n]
    inside = np.ones(n, bool)
    for e in range(1, GRAM):  # grams that run into the next text
        at = np.cumsum(sizes)[:-1] - e
        inside[at[at < n]] = False
    h, owner = h[inside], owner[inside]
    x = _mix(h)
    best = np.full(len(texts) * BINS, _EMPTY, np.uint32)
    np.minimum.at(best, owner * BINS + (x >> np.uint32(25)), x << np.uint32(7))
    best = best.reshape(len(texts), BINS)
    empty = best == _EMPTY
    if empty.any():  # fill from the next bin that has a gram, marked by the distance
        index = np.where(empty, BINS * 2, np.arange(BINS))
        index = np.concatenate((index, np.where(empty, BINS * 2, np.arange(BINS) + BINS)), 1)
        nearest = np.minimum.accumulate(index[:, ::-1], 1)[:, ::-1][:, :BINS]
        rows = np.arange(len(texts))[:, None]
        far = (nearest - np.arange(BINS)).astype(np.uint32)
        best = best[rows, nearest % BINS] + far * np.uint32(0x9E3779B1)
    return best


def sketches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row of minima, as two words."""
    bits = (_mix(m.copy()) & np.uint32(1)).astype(np.uint8)
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return words[:, 0], words[:, 1]


def band_keys(m: np.ndarray) -> np.ndarray:
    """(records, BANDS) 64-bit keys: a hash of the band's minima."""
    keys = np.empty((len(m), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(m), 0xCBF29CE484222325 + b * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for r in range(ROWS):
            x = (x ^ m[:, (b + r * BANDS) * 3 % BINS].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(32)
        keys[:, b] = x
    return keys


def prefix_keys(text: str, threshold: float = THRESHOLD) -> np.ndarray:
    """Keys of a text of few 5-grams: texts of similarity ``threshold`` share one at least. The lowest bit tells them
    from band keys."""
    grams = sorted({xxhash.xxh64_intdigest(text[i : i + GRAM]) for i in range(len(text) - GRAM + 1)})
    n = len(grams) - -(-int(threshold * 1000) * len(grams) // 1000) + 1
    return np.array(grams[:n], np.uint64) | np.uint64(1)


def buckets(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the records of each key with more than one record."""
    starts = np.flatnonzero(np.concatenate(([True], records["key"][1:] != records["key"][:-1])))
    ends = np.concatenate((starts[1:], [len(records)]))
    some = ends - starts > 1
    return starts[some], ends[some]


def trie_join(records: np.ndarray, roots: tuple[np.ndarray, ...], budget: int = BUDGET):
    """Yields (i, j) arrays of the places of records below each pair of roots that differ in at most ``budget`` bits of the sketch.

    records, sorted by (a, b) below each root, are the leaves of the trie in order; a node is a range of them. roots are the
    ranges (from, to, from, to) of nodes at the top of the sketch; a node paired with itself has its pairs once. Levels are
    taken eight bits at a time, from the top bits down.
    """
    a, b, hi, lo = (np.ascontiguousarray(records[x]) for x in ("a", "b", "hi", "lo"))
    stack = [(0, *roots, np.zeros(len(roots[0]), np.int64))]
    while stack:
        level, lo1, hi1, lo2, hi2, spent = stack.pop()
        if len(lo1) > CHUNK:
            half = len(lo1) // 2
            stack += [(level, *(x[:half] for x in (lo1, hi1, lo2, hi2, spent))), (level, *(x[half:] for x in (lo1, hi1, lo2, hi2, spent)))]
            continue
        product = (hi1 - lo1) * (hi2 - lo2)
        small = (product <= LEAF) | (level == 16)
        if small.any():  # records below small pairs of nodes: each with those of the other node, or after it in its own
            n1 = (hi1 - lo1)[small]
            r = np.repeat(lo1[small] - (np.cumsum(n1) - n1), n1) + np.arange(n1.sum())
            begin = np.where(np.repeat((lo1 == lo2)[small], n1), r + 1, np.repeat(lo2[small], n1))
            count = np.repeat(hi2[small], n1) - begin
            total = np.cumsum(count)
            first = 0
            while first < len(r):  # in chunks
                to = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CHUNK, "right")))
                own, n = r[first:to], count[first:to]
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[first:to], n)
                differ = np.bitwise_count(np.repeat(a[own], n) ^ a[j]) + np.bitwise_count(np.repeat(b[own], n) ^ b[j])
                near = np.flatnonzero(differ <= budget)
                if len(near):
                    i, j = np.repeat(own, n)[near], j[near]
                    other = (lo[i] != lo[j]) | (hi[i] != hi[j])
                    if other.any():
                        yield i[other], j[other]
                first = to
        large = np.flatnonzero(~small)
        for x in large.tolist():  # children of both nodes, paired; few nodes are large
            word, shift = (a, 56 - 8 * level) if level < 8 else (b, 120 - 8 * level)

            def children(lo, hi):
                byte = (word[lo:hi] >> np.uint64(shift)).astype(np.uint8)
                s = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
                return lo + s, np.concatenate((lo + s[1:], [hi])), byte[s]

            s1, e1, v1 = children(int(lo1[x]), int(hi1[x]))
            s2, e2, v2 = (s1, e1, v1) if lo1[x] == lo2[x] else children(int(lo2[x]), int(hi2[x]))
            c1, c2 = (y.ravel() for y in np.meshgrid(np.arange(len(s1)), np.arange(len(s2)), indexing="ij"))
            now_spent = spent[x] + np.bitwise_count(v1[c1] ^ v2[c2])
            keep = now_spent <= budget
            if lo1[x] == lo2[x]:
                keep &= c1 <= c2
            c1, c2 = c1[keep], c2[keep]
            if len(c1):
                stack.append((level + 1, s1[c1], e1[c1], s2[c2], e2[c2], now_spent[keep]))


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 5-grams of each text as numbers: five code points of 12 bits each, numbered within these texts. Texts
    of more than 4,096 different code points have sets of their own kind: see alike."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.zeros(0x110000, bool)
    present[points] = True
    number = np.cumsum(present, dtype=np.uint64)
    if number[-1] > 4096:
        raise OverflowError
    own = (number - np.uint64(1))[points]
    n = max(0, len(own) - GRAM + 1)
    codes = own[:n].copy()
    for k in range(1, GRAM):
        codes = codes << np.uint64(12) | own[k : n + k]
    ends = np.cumsum([len(t) for t in texts])
    out = []
    for end, t in zip(ends.tolist(), texts):
        part = np.sort(codes[end - len(t) : end - GRAM + 1])
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
    return out


def alike(pairs: list[tuple[bytes, bytes]], texts: dict[bytes, str], threshold: float) -> list[bool]:
    """Whether the 5-gram sets of each pair of texts have similarity ``threshold`` or more. A block of texts of too many
    different code points is cut in two, at last to one pair, which is compared by sets of strings."""
    own = list({c for p in pairs for c in p})
    try:
        grams = dict(zip(own, gram_sets([texts[c] for c in own])))
    except OverflowError:
        if len(pairs) > 1:
            half = len(pairs) // 2
            return alike(pairs[:half], texts, threshold) + alike(pairs[half:], texts, threshold)
        a, b = ({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in (texts[c] for c in pairs[0]))
        return [len(a & b) >= threshold * len(a | b)]
    out = []
    for x, y in pairs:
        a, b = grams[x], grams[y]
        if min(len(a), len(b)) < threshold * max(len(a), len(b)):
            out.append(False)
            continue
        both = np.sort(np.concatenate((a, b)))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(common / (len(a) + len(b) - common) >= threshold)
    return out


def _records(df: DataFrame) -> DataFrame:
    """(tab, id, text) of texts that may have a gram."""
    return df.select("tab", "id", "text").filter((F.length("text") >= GRAM) & F.col("id").isNotNull())


def _content(df: DataFrame) -> DataFrame:
    """(tab, id, c binary, text): content id and normal text of records with at least one gram."""

    def run(batches):
        for batch in batches:
            tabs, texts = batch.column(0).to_pylist(), [normal(t) for t in batch.column(2).to_pylist()]
            ids = pa.array([content_id(tab, t) if len(t) >= GRAM else None for tab, t in zip(tabs, texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.array(texts, pa.string())], ["tab", "id", "c", "text"])

    return _records(df).mapInArrow(run, "tab string, id string, c binary, text string").filter("c IS NOT NULL")


def _rows_of(ids: list[bytes], texts: list[str], salts: list[str | None]) -> np.ndarray:
    """Records of the texts for each of their keys; each table (salt) joins with itself."""
    m = minima(texts)
    a, b = sketches(m)
    number = {t: np.uint64(xxhash.xxh64_intdigest(t or "") & ~1 & 0xFFFFFFFFFFFFFFFF) for t in set(salts)}
    salt = np.array([number[t] for t in salts], np.uint64)
    keys = (band_keys(m) & ~np.uint64(1)) ^ salt[:, None]
    few = [(i, prefix_keys(t) ^ salt[i]) for i, t in enumerate(texts) if len(t) - GRAM + 1 <= FEW]
    at = np.concatenate([np.repeat(np.arange(len(texts)), BANDS), *(np.full(len(k), i) for i, k in few)])
    both = np.frombuffer(b"".join(ids), "<u8").reshape(-1, 2)
    rows = np.empty(len(at), RECORD)
    rows["key"] = np.concatenate([keys.ravel(), *(k for _, k in few)])
    rows["hi"], rows["lo"], rows["a"], rows["b"] = both[at, 0], both[at, 1], a[at], b[at]
    return rows


def _distinct(batches, seen: set[bytes]):
    """(ids, texts, tables) of the contents of the batches of (tab, id, text) not seen before, some thousand at a time."""
    for batch in batches:
        tabs, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for begin in range(0, len(texts), 4000):
            ids, fresh, own = [], [], []
            for tab, t in zip(tabs[begin : begin + 4000], texts[begin : begin + 4000]):
                t = normal(t)
                if len(t) >= GRAM and (c := content_id(tab, t)) not in seen:
                    seen.add(c)
                    ids.append(c)
                    fresh.append(t)
                    own.append(tab)
            if fresh:
                yield ids, fresh, own


def _frequent(df: DataFrame, share: int = SHARE) -> dict[int, int]:
    """Keys of very many records and the groups each is cut into, judged by one in ``share`` records. Only the cutting
    depends on it. A key in it has a PART_BYTES of records, so there are fewer of them than tasks."""
    most = PART_BYTES // RECORD.itemsize

    def keys(batches):
        for ids, texts, tabs in _distinct(batches, set()):
            k, n = np.unique(_rows_of(ids, texts, tabs)["key"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])

    sample = _records(df).filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    counts = sample.mapInArrow(keys, "key bigint, n bigint").groupBy("key").agg((F.sum("n") * share).alias("n")).filter(F.col("n") > most)
    return {r.key & 0xFFFFFFFFFFFFFFFF: -(-r.n // most) for r in counts.collect()}


def _cut_frequent(rows: np.ndarray, groups: dict[int, int]) -> np.ndarray:
    """Records of a frequent key go to the pairs of their group with every group, each pair under a key of its own."""
    hot = np.isin(rows["key"], np.fromiter(groups, np.uint64, len(groups)))
    if not hot.any():
        return rows
    out = [rows[~hot]]
    for r in rows[hot]:
        n = groups[int(r["key"])]
        own = int(r["lo"]) % n
        copies = np.repeat(r[None], n)
        pair = np.array([(min(own, k) * n + max(own, k) + 1) for k in range(n)], np.uint64)
        copies["key"] = (r["key"] ^ (pair * _ODD << np.uint64(1))) & ~np.uint64(1) | (r["key"] & np.uint64(1))
        out.append(copies)
    return np.concatenate(out)


def _binary(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    data = np.stack((hi, lo), 1)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _pair(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    """Content ids of the pairs, the lesser (by hi and lo) first."""
    turned = (rows["hi"][i] > rows["hi"][j]) | (rows["hi"][i] == rows["hi"][j]) & (rows["lo"][i] > rows["lo"][j])
    x, y = np.where(turned, j, i), np.where(turned, i, j)
    return [_binary(rows["hi"][x], rows["lo"][x]), _binary(rows["hi"][y], rows["lo"][y])]


def parts_of(spark, records: int) -> int:
    """Parts into which the records are cut: as many as hold PART_BYTES each, but at least a few for each of the shuffle's."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-records * (BANDS + 1) * RECORD.itemsize // PART_BYTES))


def candidates(df: DataFrame) -> DataFrame:
    """(a binary, b binary), distinct: content ids of different texts that the trie join finds."""
    parts = parts_of(df.sparkSession, df.count())
    groups = _frequent(df)

    def pack(batches):
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def flush():
            rows = np.concatenate(held)
            target = ((rows["key"] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            target = target.astype(np.uint16 if parts < 1 << 16 else np.uint32)
            order = np.argsort(target, kind="stable")
            rows, target = rows[order], target[order]
            own = np.unique(target)
            cuts = [*np.searchsorted(target, own).tolist(), len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([rows[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], ["part", "rows"])
            held.clear()

        size = 0
        for ids, texts, tabs in _distinct(batches, seen):
            rows = _rows_of(ids, texts, tabs)
            held.append(_cut_frequent(rows, groups) if groups else rows)
            size += len(held[-1])
            if size >= FLUSH * BANDS:
                yield from flush()
                size = 0
                seen.clear()
        if held:
            yield from flush()

    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])

    def pairs_of(rows, roots, budget):
        for i, j in trie_join(rows, roots, budget):
            none = pa.nulls(len(i), pa.binary())
            yield pa.RecordBatch.from_arrays([*_pair(rows, i, j), none, none], schema=out)

    def join(batches):
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        rows = np.frombuffer(b"".join(blobs), RECORD)
        blobs.clear()
        # most keys are single; only the others need the order of the trie
        order = np.argsort(keys := np.ascontiguousarray(rows["key"]))
        keys = keys[order]
        same = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
        rows = rows[order[same[1:] | same[:-1]]]
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["b"], rows["a"], rows["key"]))]
        if len(rows) > 1:  # copies of a text enter a bucket once
            same = (rows["key"][1:] == rows["key"][:-1]) & (rows["lo"][1:] == rows["lo"][:-1]) & (rows["hi"][1:] == rows["hi"][:-1])
            rows = rows[np.concatenate(([True], ~same))]
        starts, ends = buckets(rows)
        hot = ends - starts > HOT
        few = (rows["key"][starts] & np.uint64(1)).astype(bool)
        for own, budget in ((~hot & ~few, BUDGET), (~hot & few, FEW_BUDGET)):
            if own.any():
                yield from pairs_of(rows, (starts[own], ends[own], starts[own], ends[own]), budget)
        for lo, hi in zip(starts[hot].tolist(), ends[hot].tolist()):
            cuts = np.linspace(lo, hi, -(-(hi - lo) // HOT) + 1).astype(int)
            for i in range(len(cuts) - 1):
                for j in range(i, len(cuts) - 1):
                    left, right = rows[cuts[i] : cuts[i + 1]].tobytes(), rows[cuts[j] : cuts[j + 1]].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([left]), pa.array([None if i == j else right], pa.binary())], schema=out)

    def blocks(batches):
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(left, RECORD)
                y = x if right is None else np.frombuffer(right, RECORD)
                rows = x if right is None else np.concatenate((x, y))
                first = 0 if right is None else len(x)
                budget = FEW_BUDGET if int(rows["key"][0]) & 1 else BUDGET
                for i, j in trie_join(rows, tuple(np.array([v]) for v in (0, len(x), first, len(rows))), budget):
                    yield pa.RecordBatch.from_arrays(_pair(rows, i, j), ["a", "b"])

    packed = _records(df).mapInArrow(pack, "part int, rows binary")
    joined = written(packed.repartition(parts, "part").mapInArrow(join, "a binary, b binary, left binary, right binary"), "joined")
    found, cut_up = joined.filter("left IS NULL").select("a", "b"), joined.filter("left IS NOT NULL").select("left", "right")
    if cut_up.head(1):
        found = found.unionByName(cut_up.repartition(parts).mapInArrow(blocks, "a binary, b binary"))
    return found.distinct()


def similar_texts(df: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of content ids of similarity ``threshold`` or more, and members (tab, id, c) of all content."""
    found = written(candidates(df), "candidates")
    needed = cut(found.select(F.col("a").alias("c")).unionByName(found.select(F.col("b").alias("c"))).distinct())
    known = join_checked(_content(df), needed.withColumn("near", F.lit(True)), ["c"], "left")
    content = written(known.select("tab", "id", "c", F.when(F.col("near"), F.col("text")).alias("text")), "content")
    texts = written(content.filter("text IS NOT NULL").groupBy("c").agg(F.first("text").alias("text")), "texts")

    def verify(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, COMPARED):
                part = batch.slice(i, COMPARED)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                own = dict(zip(a, part.column(2).to_pylist())) | dict(zip(b, part.column(3).to_pylist()))
                yield part.select(["a", "b"]).filter(pa.array(alike(list(zip(a, b)), own, threshold), pa.bool_()))

    one = join_hot(found, texts.select(F.col("c").alias("a"), F.col("text").alias("s")), ["a"])
    both = join_hot(one, texts.select(F.col("c").alias("b"), F.col("text").alias("t")), ["b"])
    pairs = written(both.select("a", "b", "s", "t").mapInArrow(verify, "a binary, b binary"), "pairs")
    members = written(content.groupBy("tab", "id").agg(F.min("c").alias("c")), "members")
    return pairs, members


def similar_records(df: DataFrame, threshold: float = THRESHOLD, within: int = WITHIN) -> DataFrame:
    """df: (tab, id, text). (tab, id_a, id_b): pairs of records of one table, id_a < id_b."""
    pairs, members = similar_texts(df, threshold)
    sizes = members.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    copied = cut(sizes.filter("n > 1"))
    copies = join_checked(members, copied, ["c"])
    few, many = copies.filter(F.col("n") <= within), copies.filter(F.col("n") > within)
    inside = few.select("tab", "c", F.col("id").alias("x")).join(few.select("c", F.col("id").alias("y")), "c").filter("x < y").select("tab", "x", "y")
    star = many.filter("id <> first").select("tab", F.col("first").alias("x"), F.col("id").alias("y"))
    # across texts: members of small groups in full, of large ones by their first record and, for the others, with the partner's first
    touched = cut(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct())
    near = join_checked(join_checked(members, touched, ["c"], "left_semi"), copied.select("c", "n", "first"), ["c"], "left")
    near = near.select("tab", "c", "id", (F.coalesce("n", F.lit(1)) > within).alias("big"), (F.coalesce("first", F.col("id")) == F.col("id")).alias("lead"))
    left = near.select("tab", F.col("c").alias("a"), F.col("id").alias("x"), F.col("big").alias("big_x"), F.col("lead").alias("lead_x"))
    right = near.select(F.col("c").alias("b"), F.col("id").alias("y"), F.col("big").alias("big_y"), F.col("lead").alias("lead_y"))
    plain = join_hot(join_hot(pairs, left, ["a"]), right, ["b"]).filter("(NOT big_x OR lead_x OR lead_y) AND (NOT big_y OR lead_y OR lead_x)").select("tab", "x", "y")
    both = inside.unionByName(star).unionByName(plain).filter("x <> y")
    return both.select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _nearest(links: DataFrame) -> DataFrame:
    """links: (u, v). The same with m, the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return join_hot(links, least.select("u", F.least("u", "m").alias("m")), ["u"])


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). (c, l): each node and the least node of its connected component.

    Large and small stars in turn: every node hands its larger neighbours, then itself and its smaller ones, to the least
    of them. The rounds grow with the logarithm of the nodes, also on chains; they end when only stars are left.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(cut(large))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(near.select("u", F.col("m").alias("v")))
        links = cut(small.distinct())
        ends = links.select(F.col("u").alias("c"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("c"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("c").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").head(1):
            break
    return links.select(F.col("u").alias("c"), F.col("v").alias("l")).unionByName(links.select(F.col("v").alias("c"), F.col("v").alias("l")).distinct())


def groups(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(tab, id, group_id string, links bigint), one row for each record with a text: the connected component of similar
    records, named by its first record, and how many different texts the record's own is linked to.
    """
    pairs, members = similar_texts(df, threshold)
    labels = components(pairs)
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = edges.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("links"))
    known = members.join(labels, "c", "left").join(links, "c", "left").select("tab", "id", F.coalesce("l", "c").alias("l"), F.coalesce("links", F.lit(0)).alias("links"))
    names = known.groupBy("tab", "l").agg(F.min("id").alias("group_id"))
    return known.join(names, ["tab", "l"]).select("tab", "id", "group_id", "links")

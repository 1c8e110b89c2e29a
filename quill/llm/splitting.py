"""Cutting of oversized texts into pieces under a size limit.

Recursive separator hierarchy: a stretch above the budget is cut at sections, what is still too large at paragraphs,
then lines, sentences, words and at last characters; the resulting parts are packed greedily to the limit. Each later
piece opens with the last sentence of the piece before, at most ``overlap`` code points of it.

Defined results: texts up to the limit and null texts have no pieces (they need no cut); pieces without their overlaps,
on end, give the text back exactly; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quill.llm.sentences import starts_of

LIMIT = 2000
OVERLAP = 200

_section = re.compile(r"(?m)^(?=#{1,6}\s|={2,6}[^=]|\\(?:sub)*section|<h[1-6][\s>])|(?<=\x0c)")
_paragraph = re.compile(r"\n[^\S\n]*\n\s*")
_line = re.compile(r"\n+")
_word = re.compile(r"\s+")


def parts(text: str, begin: int, end: int, budget: int, starts: np.ndarray, level: int = 0) -> list[int]:
    """Ends of the parts of text[begin:end], each at most budget long, cut at the highest level that does."""
    if end - begin <= budget:
        return [end]
    if level == 0:
        at = [m.start() for m in _section.finditer(text, begin, end)]
    elif level == 1:
        at = [m.end() for m in _paragraph.finditer(text, begin, end)]
    elif level == 2:
        at = [m.end() for m in _line.finditer(text, begin, end)]
    elif level == 3:
        at = starts[np.searchsorted(starts, begin, "right") : np.searchsorted(starts, end)].tolist()
    elif level == 4:
        at = [m.end() for m in _word.finditer(text, begin, end)]
    else:
        return [*range(begin + budget, end, budget), end]
    out, before = [], begin
    for cut in [*(a for a in at if begin < a < end), end]:
        if cut > before:
            out += parts(text, before, cut, budget, starts, level + 1)
            before = cut
    return out


def pieces(text: str, starts: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, end, overlap before begin) of each piece."""
    ends = parts(text, 0, len(text), limit - overlap, starts)
    out, begin, shared, last = [], 0, 0, 0
    for end in ends:
        if end - begin + shared > limit:
            out.append((begin, last, shared))
            at = int(np.searchsorted(starts, last)) - 1  # the sentence that ends the piece
            opens = max(begin - shared, int(starts[at]) if at >= 0 else 0)
            if last - opens > overlap:
                opens = last - overlap
                if word := _word.search(text, opens, last - 1):
                    opens = word.end()
            begin, shared = last, last - opens
        last = end
    out.append((begin, last, shared))
    return out


def split_oversized(df: DataFrame, key: str = "item", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece int, start int, shared int, text string): pieces in order; start is the offset of the piece's new
    part, shared how many code points before it the piece repeats."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            which, offset = starts_of(texts)
            first = np.searchsorted(which, np.arange(len(texts) + 1))
            rows, out = [], []
            for i, t in enumerate(texts):
                own = pieces(t, offset[first[i] : first[i + 1]], limit, overlap)
                rows += [i] * len(own)
                out += [(n, b, s, t[b - s : e]) for n, (b, e, s) in enumerate(own)]
            number, start, shared, text_ = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(shared, pa.int32()), pa.array(text_, pa.string())], ["key", "piece", "start", "shared", "text"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit).mapInArrow(run, f"key {kind}, piece int, start int, shared int, text string").withColumnRenamed("key", key)

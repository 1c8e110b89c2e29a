"""Sentence splitting and packing of sentences into chunks, as expressions over one row.

A document's sentences and chunks depend on that document alone, so folds over arrays replace shuffles.
Sentences themselves are found in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

from quill.functions import text as T
from quill.operators.ordinals import with_ordinal

#: Abbreviations after whose dot a sentence goes on.
ABBREVIATIONS = (
    "sr", "sra", "srta", "dr", "dra", "prof", "ing", "lic", "gral", "cnel", "tte",
    "mr", "mrs", "ms", "jr", "sr.", "st", "mt",
    "fig", "figs", "tab", "tabla", "ec", "eq", "ref", "refs", "cap", "sec", "art",
    "pag", "pags", "pp", "p", "vol", "no", "nro", "num", "ed", "eds", "al",
    "etc", "vs", "ej", "cf", "ca", "aprox", "e.g", "i.e", "ss", "op", "cit",
    "ee", "uu", "ee.uu", "dept", "univ", "inc", "ltd", "corp", "gob",
)
#: Where an overlong sentence may be cut, in order of preference.
SECONDARY = ("•", "; ", ": ", " | ", " – ", " — ")
#: Fixed value: a possible boundary: terminator, then closing marks and space (the delimiter), then the start of a sentence.
BOUNDARY = "([.!?…])([\"'”’)\\]]*\\s+)([\"'“¿¡(\\[]*[A-ZÀ-Ý0-9])"
CUT, BODY = "\x01", "\x02"


def false_break(left: Column) -> Column:
    """Whether the boundary after this text is none: abbreviation, inner dots, initial or number."""
    token = F.lower(F.rtrim(F.regexp_extract(left, "(?U)([\\wÀ-ÿ.]+)[\"'”’)\\]]*\\s*$", 1), F.lit(".")))
    known = F.lit("|" + "|".join(ABBREVIATIONS) + "|")
    return T.let(token, lambda t: (t != "") & ((F.length(t) == 1) | t.contains(".") | t.rlike(r"^\p{Nd}+$") | known.contains(F.concat(F.lit("|"), t, F.lit("|")))))


_boundary = re.compile(BOUNDARY.replace("\\s", "[ \\t\\n\\x0b\\f\\r]"))
#: Letters, marks, digits and connectors, as in a word of the expression above.
_token = re.compile("[\\w.À-ÿ\u200c\u200d\u203f\u2040\u2054" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c)[0] == "M") + "]+\\Z")


def split_sentences(text: str) -> list[str]:
    """Sentences of one text: see sentence_expression. Each is a slice of the text, and only after a dot can a break be
    false, so one search for boundaries is all the work."""
    out, start, piece = [], 0, 0
    for m in _boundary.finditer(text):
        end = m.end(1)
        if text[end - 1] != "." or not _goes_on(text[max(piece, end - 40) : end]):
            if s := text[start:end].strip():
                out.append(s)
            start = m.start(3)
        piece = m.start(3)
    if s := text[start:].strip():
        out.append(s)
    return out


def _goes_on(left: str) -> bool:
    word = left[left.rfind(" ") + 1 :]
    t = word[:-1]
    if not t.isalpha():
        t = _token.search(word).group().rstrip(".")
    t = t.lower()
    return t != "" and (len(t) == 1 or t in _known or "." in t or t.isdecimal())


_known = frozenset(ABBREVIATIONS)


@F.arrow_udf(ArrayType(StringType()))
def _sentences(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else split_sentences(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def sentence_array(text: str | Column) -> Column:
    """Sentences of a text whose white space has been collapsed, in Arrow batches; several times as fast as the expression
    of the same result, which is for places where no function of Python can stand (within lambdas)."""
    return _sentences(T.lit_or_col(text))


def sentence_expression(text: str | Column) -> Column:
    """Sentences of a text whose white space has been collapsed; empty array for an empty text, null for null.

    Boundaries are marked and cut; a piece starts a sentence unless the one before ends in a false break. Each sentence is
    the slice of pieces from one start to the next, so the work is linear in the text.
    """
    marked = F.regexp_replace(T.lit_or_col(text), BOUNDARY, f"$1{CUT}$2{BODY}$3")

    def piece(p: Column) -> Column:
        body = F.substring_index(p, BODY, -1)
        # only the end of a piece decides; a long piece isn't searched from its start
        return F.struct(F.when(p.contains(BODY), F.substring_index(p, BODY, 1)).otherwise("").alias("gap"), body.alias("body"), false_break(F.right(body, F.lit(40))).alias("fb"))

    def glued(pieces: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: (i == 1) | ~F.element_at(pieces, F.greatest(i - 1, F.lit(1)))["fb"])

        def sentence(starts: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                after = F.coalesce(F.try_element_at(starts, k + 2), F.size(pieces) + 1)
                rest = F.transform(F.slice(pieces, s + 1, after - s - 1), lambda p: F.concat(p["gap"], p["body"]))
                first = F.element_at(pieces, s)["body"]
                return T.strip(F.when(after == s + 1, first).otherwise(F.concat(first, F.array_join(rest, ""))))

            return F.transform(starts, one)

        return T.let(starts, sentence)

    return F.filter(T.let(F.transform(F.split(marked, CUT), piece), glued), lambda s: s != "")


def capped(sentences: Column, most: int) -> Column:
    """Sentences of more than ``most`` words cut into windows of that many."""

    def windows(s: Column) -> Column:
        return T.let(
            T.words(s),
            lambda w: F.when(F.size(w) <= most, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(w, i * most + 1, F.lit(most)), " "))),
        )

    return F.flatten(F.transform(sentences, windows))


def packed(sentences: Column, most: int, overlap: int = 1) -> Column:
    """array<struct<posicion, texto, num_tokens>>: greedy packing up to ``most`` words, each later chunk opening with the
    last ``overlap`` sentences of the one before. The fold keeps ranges of sentences, not their texts."""
    return T.let(sentences, lambda own: T.let(F.transform(own, T.word_count), lambda sizes: _packed(own, sizes, most, overlap)))


def _packed(sentences: Column, sizes: Column, most: int, overlap: int) -> Column:
    start = F.struct(F.array().cast("array<struct<a:int,b:int,n:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def total(a: Column, b: Column) -> Column:
        return F.aggregate(F.slice(sizes, a + 1, b - a), F.lit(0), lambda x, y: x + y)

    def step(acc: Column, n: Column) -> Column:
        full = (acc["b"] > acc["a"]) & (acc["n"] + n > most)
        head = F.greatest(acc["a"], acc["b"] - overlap)
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b"), acc["n"].alias("n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, head).otherwise(acc["a"]).alias("a"),
            (acc["b"] + 1).alias("b"),
            (F.when(full, total(head, acc["b"])).otherwise(acc["n"]) + n).alias("n"),
        )

    ranges = F.aggregate(sizes, start, step, lambda acc: F.when(acc["b"] > acc["a"], F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b"), acc["n"].alias("n")))).otherwise(acc["done"]))
    return F.transform(ranges, lambda r, i: F.struct(i.alias("posicion"), F.array_join(F.slice(sentences, r["a"] + 1, r["b"] - r["a"]), " ").alias("texto"), r["n"].alias("num_tokens")))


def _joined(parts: Column, most: int) -> Column:
    """parts: array<struct<text, alone>>. Texts packed up to ``most`` words without overlap; a part marked alone stays so."""

    def ranges(own: Column) -> Column:
        sized = F.transform(own, lambda p: F.struct(T.word_count(p["text"]).alias("n"), p["alone"].alias("alone")))
        empty = F.array().cast("array<struct<a:int,b:int>>")
        start = F.struct(empty.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(False).alias("shut"))

        def step(acc: Column, p: Column) -> Column:
            full = (acc["b"] > acc["a"]) & (acc["shut"] | p["alone"] | (acc["n"] + p["n"] > most))
            return F.struct(
                F.when(full, F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")))).otherwise(acc["done"]).alias("done"),
                F.when(full, acc["b"]).otherwise(acc["a"]).alias("a"),
                (acc["b"] + 1).alias("b"),
                (F.when(full, 0).otherwise(acc["n"]) + p["n"]).alias("n"),
                p["alone"].alias("shut"),
            )

        last = lambda acc: F.when(acc["b"] > acc["a"], F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")))).otherwise(acc["done"])
        return F.transform(F.aggregate(sized, start, step, last), lambda r: F.array_join(F.transform(F.slice(own, r["a"] + 1, r["b"] - r["a"]), lambda p: p["text"]), " "))

    return T.let(parts, ranges)


def secondary(sentence: Column, most: int) -> Column:
    """An overlong sentence cut at the first kind of secondary boundary whose parts all fit, else into windows of words."""

    def tried(mark: Column) -> Column:
        pieces = F.filter(F.transform(F.split(sentence, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1), T.strip), lambda p: p != "")
        parts = F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(False).alias("alone")))
        return F.when(sentence.contains(mark), T.let(parts, lambda own: F.when(F.size(own) >= 2, _joined(own, most))))

    tries = F.transform(F.array(*[F.lit(m) for m in SECONDARY]), tried)
    fitting = F.filter(tries, lambda t: t.isNotNull() & F.forall(t, lambda x: T.word_count(x) <= most))
    return F.coalesce(F.try_element_at(fitting, F.lit(1)), capped(F.array(sentence), most))


def output_parts(text: str | Column, most: int = 250) -> Column:
    """Parts of at most ``most`` words made of whole sentences, without overlap; overlong sentences are cut and not mixed
    with their neighbours."""

    def parts(s: Column) -> Column:
        short = F.array(F.struct(s.alias("text"), F.lit(False).alias("alone")))
        return F.when(T.word_count(s) <= most, short).otherwise(F.transform(secondary(s, most), lambda x: F.struct(x.alias("text"), F.lit(True).alias("alone"))))

    def divided(c: Column) -> Column:
        joined = F.filter(F.transform(_joined(F.flatten(F.transform(sentence_expression(c), parts)), most), T.strip), lambda x: x != "")
        return F.when(T.word_count(c) <= most, F.array(T.strip(c))).otherwise(joined)

    return T.let(T.lit_or_col(text), divided)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 384, overlap: int = 1) -> DataFrame:
    """(key, posicion, texto, num_tokens): documents cleaned, split and packed; narrow, one row for each chunk."""
    found = docs.select(F.col(key), sentence_array(F.col(text)).alias("sentences"))
    sentences = found.select(key, capped(F.col("sentences"), most).alias("sentences"))
    return sentences.select(key, F.explode(packed(F.col("sentences"), most, overlap)).alias("c")).select(key, "c.*")


def kept_chunks(chunks: DataFrame, least: int, key: str = "doc_id", size: str | None = None) -> DataFrame:
    """Chunks of at least ``least`` characters; of a document without any, its longest (the first of equals). ``size`` names
    a column of lengths that takes the place of the text."""
    length = F.col(size) if size else F.length("texto")
    w = Window.partitionBy(key)
    ranked = chunks.withColumn("_most", F.max(length).over(w)).withColumn("_n", F.row_number().over(w.orderBy(length.desc(), "posicion")))
    return ranked.filter((length >= least) | ((F.col("_most") < least) & (F.col("_n") == 1))).drop("_most", "_n")


def first_chunks(chunks: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The first ``most`` chunks of each document; 0 keeps all."""
    if not most:
        return chunks
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("posicion"))).filter(F.col("_n") <= most).drop("_n")


def numbered(chunks: DataFrame, key: str = "doc_id", start: int = 0) -> DataFrame:
    """chunks with chunk_id, the ordinal over (document, posicion) from ``start``, and chunk_uid."""
    rows = with_ordinal(chunks, [key, "posicion"], "_n", start)
    return rows.select(*chunks.columns, F.col("_n").cast("string").alias("chunk_id"), F.format_string("%s-chunk-%04d", F.col(key).cast("string"), F.col("posicion")).alias("chunk_uid"))

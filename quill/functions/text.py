"""Text columns: Unicode repair, noise and boilerplate lines, cleaning, words, sentence opening and closing.

Everything but NFC is a JVM expression over one row; no shuffle is needed even for rules that count lines of a document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: Limits of a header or footer that a document repeats.
REPEATS, HEADER_LENGTH = 4, 70
LEADER = r"(?U)(?:\s*\.\s*){3,}"
NOISE = r"(?U)^[\s.\-–—•·|0-9]*$"
CONTENTS_ENTRY = r"(?U)^.+\.\s*\.\s*\.\s*.*\d+\s*$"


def lit_or_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


_nfc = _nfc.asNondeterministic()  # keeps the optimiser from moving it into expressions over arrays


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unicode_fix(text: str | Column) -> Column:
    """NFC without any control, format, private or unassigned character but line end and tab. Null stays null."""
    return F.regexp_replace(_nfc(lit_or_col(text)), r"[\p{C}&&[^\n\t]]", "")


def strip(c: str | Column) -> Column:
    return F.regexp_replace(lit_or_col(c), r"(?U)^\s+|\s+$", "")


def words(c: str | Column) -> Column:
    """Array of the words between white space; empty for a blank text."""
    return F.filter(F.split(lit_or_col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def noise_line(line: Column) -> Column:
    s = strip(line)
    return s.rlike(NOISE) | (s.rlike(LEADER) & s.rlike(CONTENTS_ENTRY))


def boilerplate(lines: Column) -> Column:
    """Distinct stripped lines that the array repeats REPEATS times or more: equal neighbours at that distance when sorted."""
    short = F.sort_array(F.filter(F.transform(lines, strip), lambda s: (s != "") & (F.length(s) <= HEADER_LENGTH)))

    def repeated(s: Column) -> Column:
        last = F.size(s) - (REPEATS - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(F.filter(at, lambda i: F.element_at(s, i) == F.element_at(s, i + (REPEATS - 1))), lambda i: F.element_at(s, i)))

    return let(short, repeated)


def clean(fixed: str | Column, drop_boilerplate: bool = True) -> Column:
    """One line of running text of a text after unicode_fix (in a column of its own): without noise and repeated lines,
    leaders closed up, words cut at line ends rejoined. Null stays null."""

    def kept(lines: Column) -> Column:
        none = F.array().cast("array<string>")
        return let(boilerplate(lines) if drop_boilerplate else none, lambda out: F.filter(lines, lambda x: ~F.array_contains(out, strip(x)) & ~noise_line(x)))

    tidy = F.transform(let(F.split(lit_or_col(fixed), "\n", -1), kept), lambda x: strip(F.regexp_replace(F.regexp_replace(x, LEADER, " "), r"[ \t]{2,}", " ")))
    joined = dehyphenate(F.array_join(F.filter(tidy, lambda x: x != ""), "\n"))
    return F.btrim(F.regexp_replace(F.regexp_replace(joined, "\n", " "), r"[ \t]{2,}", " "))


def cleaned(docs: DataFrame, text: str = "text", drop_boilerplate: bool = True) -> DataFrame:
    """docs with the text column cleaned; narrow."""
    return docs.withColumn(text, unicode_fix(text)).withColumn(text, clean(text, drop_boilerplate))


def cleaned_pages(docs: DataFrame, pages: str, text: str = "text", drop_boilerplate: bool = True) -> DataFrame:
    """docs with a column of clean text made of an array of pages."""
    return cleaned(docs.withColumn(text, F.array_join(pages, "\n")), text, drop_boilerplate)


def dehyphenate(text: str | Column) -> Column:
    """Joins a line that ends in letter and hyphen to the next if that begins with a small letter."""
    return F.regexp_replace(lit_or_col(text), r"([A-Za-zÀ-ÿ])-\n(?=\p{Ll})", "$1")


def opens_well(c: str | Column) -> Column:
    return lit_or_col(c).rlike(r"(?U)^\s*[\p{Lu}\p{Lt}\p{Nd}¿¡\"«“(\[•—]")


def closes_well(c: str | Column) -> Column:
    return lit_or_col(c).rlike(r"(?U)[.!?\"»”)\]…]\s*$")


def well_formed(c: str | Column) -> Column:
    return opens_well(c) & closes_well(c)


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(lit_or_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

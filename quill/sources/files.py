"""Files to documents: corpus scan, formats, inventory, readers of text, JSON, tables and HTML, JSON lines."""

from __future__ import annotations

import html as htmllib
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from quill.functions import text as T
from quill.operators.ordinals import with_ordinal
from quill.sources.tables import records, workbook_text
from quill.sources.tiles import tile_text

#: Logical format of each extension.
FORMATS = {
    "pdf": "pdf", "html": "html", "htm": "html", "md": "md", "txt": "md", "json": "json", "csv": "csv", "xlsx": "xlsx", "xls": "xlsx",
    "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "avif": "image", "webp": "image", "gif": "image", "bmp": "image", "pbf": "pbf",
}
#: Keys of JSON whose values hold no text for retrieval, and keys whose texts come first.
SKIPPED_KEYS = (
    "url", "url_page", "url_pdf", "urls", "link", "links", "pdf_links", "href",
    "path", "filename", "file", "filepath", "image", "images", "thumbnail",
    "id", "study_id", "doc_id", "uuid", "slug", "hash",
    "size_bytes", "size_mb", "status", "scraped_at", "timestamp", "updated_at",
    "contenido_limitado", "mime", "extension",
)
TITLE_KEYS = ("title", "titulo", "nombre", "headline", "subtitle", "subtitulo")
DEPTH, SHORTEST = 12, 3


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(T.lit_or_col(path), r"[^/.][^/]*\.([^./]+)$", 1))


def file_format(path: str | Column) -> Column:
    """Logical format by extension; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), extension(path))


def phenomenon(path: str | Column) -> Column:
    """The digit after F of the first part of a path, else 0."""
    digit = F.regexp_extract(F.split_part(T.lit_or_col(path), F.lit("/"), F.lit(1)), r"^[Ff](\d)", 1)
    return F.when(digit == "", 0).otherwise(digit.cast("int"))


def posix(path: str | Column) -> Column:
    return F.btrim(F.translate(T.lit_or_col(path), "\\", "/"), F.lit("/"))


def inventory(rows: DataFrame) -> DataFrame:
    """(fuente, doc_id, fenomeno, nombre, observatorio, tipo): one row for each path; of rows for one path the last by
    document, name and kind counts."""
    w = Window.partitionBy("fuente").orderBy(F.desc_nulls_last("doc_id"), F.desc_nulls_last("nombre"), F.desc_nulls_last("tipo"), F.desc_nulls_last("observatorio"), F.desc_nulls_last("fenomeno"))
    clean = rows.withColumn("fuente", posix("fuente"))
    return clean.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("fuente", "doc_id", F.coalesce("fenomeno", F.lit(0)).alias("fenomeno"), "nombre", "observatorio", "tipo")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(fuente, length, modified) of all files below a folder, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.expr(f"substring(path, instr(path, '{folder.rstrip('/')}') + {len(folder.rstrip('/')) + 1})").alias("fuente"), "length", "modificationTime")


def scan(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files: (fuente). (fuente, formato, doc_id, fenomeno): with an inventory the files it lists, else all files, numbered
    in the order of their paths. Unknown extensions and .ds_store are left out."""
    fit = files.filter(file_format("fuente").isNotNull() & ~F.lower("fuente").endswith(".ds_store")).withColumn("formato", extension("fuente"))
    if known is not None:
        # an inventory has a row for each file, so it is as large as the listing: both are shuffled, whatever their size
        listed = fit.select(posix("fuente").alias("fuente"), "formato").join(known.select("fuente", "doc_id", "fenomeno").hint("merge"), "fuente")
        return listed.select("fuente", "formato", "doc_id", "fenomeno")
    order = with_ordinal(files.select("fuente").distinct(), ["fuente"], "i")
    return fit.join(order, "fuente").select("fuente", "formato", F.format_string("DOC-%05d", "i").alias("doc_id"), phenomenon("fuente").alias("fenomeno"))


def _leaves(data) -> Iterator[tuple[str | None, object]]:
    """(key, value) of every text and number of a JSON value in order of the document; values of SKIPPED_KEYS and below DEPTH
    are left out. Of a list's values the key is that of the list."""
    ahead = [iter([(None, data)])]
    while ahead:
        key, value = next(ahead[-1], (None, ahead))
        if value is ahead:
            ahead.pop()
        elif isinstance(value, (dict, list)):
            if len(ahead) <= DEPTH:
                inner = ((k.lower(), v) for k, v in value.items() if k.lower() not in SKIPPED_KEYS) if isinstance(value, dict) else zip(repeat(key), value)
                ahead.append(iter(inner))
        elif isinstance(value, (str, int, float)) and len(ahead) <= DEPTH + 1:
            yield key, value


def harvest_json(raw: str | None) -> str:
    """Texts of any JSON value: titles first, then the rest, in document order, each once; "" for invalid JSON."""
    try:
        data = json.loads(raw) if raw else None
    except ValueError:
        return ""
    first: dict[str, bool] = {}
    for key, value in _leaves(data):
        text = (value if isinstance(value, str) else f"{key}: {value}" if key else "").strip()
        if len(text) >= SHORTEST and not text.startswith(("http://", "https://", "data:")):
            first.setdefault(text, isinstance(value, str) and key in TITLE_KEYS)
    return "\n\n".join(sorted(first, key=lambda t: not first[t]))


def json_text(raw: str | Column) -> Column:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(harvest_json)

    return run(T.lit_or_col(raw))


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """"name: value | name: value" of a row, without null, blank and nan cells; null for a row without any."""
    cells = [F.when(F.col(c).isNotNull() & ~F.lower(F.btrim(F.col(c).cast("string"))).isin("", "nan"), F.concat(F.lit(f"{c}: "), F.btrim(F.col(c).cast("string")))) for c in columns or df.columns]
    return F.nullif(F.concat_ws(" | ", *cells), F.lit(""))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, mode="DROPMALFORMED")


class _Page(HTMLParser):
    """Visible text of a page; blocks on lines of their own."""

    DROP = {"script", "style", "nav", "head", "noscript", "template", "svg", "form"}
    BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "blockquote", "hr", "td", "th", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.dropped: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.dropped.append(tag)
        elif tag == "body":
            self.dropped.clear()
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.dropped and tag == self.dropped[-1]:
            self.dropped.pop()
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)


def page_text(page: str | None) -> str:
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    return "\n".join(line for raw in htmllib.unescape("".join(parser.parts)).split("\n") if (line := " ".join(raw.split())))


def html_text(page: str | Column) -> Column:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(page_text)

    return run(T.lit_or_col(page))


@F.pandas_udf(StringType())
def lenient_utf8(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8, invalid ones left out."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


#: Readers by logical format: bytes of a file to its text. Others (pdf, image) are plugged in by the caller.
READERS: dict[str, Callable[[bytes], str]] = {
    "md": lambda b: b.decode("utf-8", "ignore"),
    "json": lambda b: harvest_json(b.decode("utf-8", "ignore")),
    "html": lambda b: page_text(b.decode("utf-8", "ignore")),
    "csv": lambda b: csv_text(b.decode("utf-8", "ignore")),
    "xlsx": workbook_text,
    "pbf": tile_text,
}


def csv_text(raw: str) -> str:
    """A line "name: value | name: value" for each row; the delimiter is sniffed where the comma doesn't fit."""
    import csv
    import io

    rows = list(csv.reader(io.StringIO(raw)))
    if rows and len(rows[0]) == 1:
        try:
            rows = list(csv.reader(io.StringIO(raw), csv.Sniffer().sniff(raw[:4096], ";\t|,")))
        except csv.Error:
            pass
    if not rows:
        return ""
    return records(rows[0], rows[1:])


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files: (fuente, content, ...). Adds text and error: a file that can't be read has an error and an empty text; an image
    or format without a reader has an empty text. One Arrow pass; partitions take the place of a process pool."""
    own = {**READERS, **(readers or {})}
    out = files.withColumn("logical", file_format("fuente"))
    schema = out.drop("content").schema.add("text", "string").add("error", "string")

    def run(frames):
        for frame in frames:
            texts, errors = [], []
            for kind, content in zip(frame["logical"], frame["content"]):
                try:
                    texts.append(own[kind](bytes(content)) if kind in own else "")
                    errors.append(None)
                except Exception as e:  # one bad file mustn't stop the others
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield frame.drop(columns="content").assign(text=texts, error=errors)

    return out.mapInPandas(run, schema)


def to_extract(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files not yet extracted: those without a logged success of at least one character."""
    done = log.filter(F.col("error").isNull() & (F.col("n_chars") > 0)).select("doc_id").distinct()
    return files.join(done, "doc_id", "left_anti")


def last_attempts(log: DataFrame) -> DataFrame:
    """The last attempt of each document; a success before a failure at the same time."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("logged_at"), F.col("error").asc_nulls_first(), F.desc_nulls_last("n_chars"))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def to_read_again(log: DataFrame, least: int = 50) -> DataFrame:
    """Scans for a character reader: last attempts on pdf without error that gave fewer than ``least`` characters."""
    return last_attempts(log).filter((F.lower("formato") == "pdf") & F.col("error").isNull() & (F.coalesce("n_chars", F.lit(0)) < least))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON object a line, nulls left out; in the given order across files."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)

"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quill.llm import languages, markup, near_duplicates, packing, repeated_lines, scanned, sentences, splitting, tokens, visual
from quill.session import read_table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def _both(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, item, text, label): texts of documents and chunks; chunks sent again are equal rows."""
    docs = _documents(spark, folder).select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("item"), "text", F.col("idioma").alias("label"))
    chunks = read_table(spark, folder, "chunk_meta").select(F.lit("chunk_meta").alias("tab"), F.col("chunk_id").alias("item"), F.col("texto").alias("text"), F.col("idioma").alias("label"))
    return docs.unionByName(chunks)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(_documents(spark, folder)).select("doc_id", "line_no")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(_documents(spark, folder))


def _language_words(spark: SparkSession, folder: str) -> tuple:
    docs = _documents(spark, folder).select(F.col("doc_id").alias("item"), "text", F.col("idioma").alias("label"))
    return languages.trained(docs, read_table(spark, folder, "language_names"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.other_languages(_both(spark, folder), read_table(spark, folder, "language_names"), _language_words(spark, folder))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = languages.segments(_both(spark, folder), _language_words(spark, folder))
    return found.select("tab", "item", "n", "lang", "begin", "end", F.round("confidence", 4).alias("confidence"))


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of most of each text, and its confidence; null and 0 where the text holds no language."""
    texts = _both(spark, folder)
    return languages.main_language(texts, _language_words(spark, folder))


def _pieces(spark: SparkSession, folder: str, once: bool) -> DataFrame:
    """Pieces of all oversized texts; ``once``: of chunks sent again one row only, told by a hash before they are cut."""
    rows = _both(spark, folder).filter(F.length("text") > splitting.LIMIT)
    if once:
        sent = rows.filter("tab = 'chunk_meta'").withColumn("h", F.xxhash64("text")).dropDuplicates(["item", "h"]).drop("h")
        rows = rows.filter("tab = 'documents'").unionByName(sent)
    texts = rows.select(F.struct("tab", "item").alias("id"), "text")
    flat = texts.select(F.concat_ws("\x1f", "id.tab", F.coalesce("id.item", F.lit("\x1e"))).alias("key"), "text")
    item = F.expr("nullif(substring(key, instr(key, chr(31)) + 1), chr(30))")
    return splitting.split_oversized(flat, "key").select(F.split_part("key", F.lit("\x1f"), F.lit(1)).alias("tab"), item.alias("item"), "piece", "start", "shared", "text")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, False).filter("piece = 1").select("tab", "item").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_starts(_documents(spark, folder).filter("formato = 'txt'"))


def p4_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(_documents(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.elements(_documents(spark, folder))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean(_documents(spark, folder))


def p5_prose(spark: SparkSession, folder: str) -> DataFrame:
    return markup.prose(_documents(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.findings(_documents(spark, folder))


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.repair(_documents(spark, folder))


def _alike(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "chunk_meta").select(F.lit("chunk_meta").alias("tab"), F.col("chunk_id").alias("id"), F.col("texto").alias("text"))
    fragments = read_table(spark, folder, "fragments").select(F.lit("fragments").alias("tab"), F.concat("query_id", F.lit("#"), F.col("rank").cast("string")).alias("id"), "text")
    return chunks.unionByName(fragments)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_records(_alike(spark, folder))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(_alike(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(_documents(spark, folder))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.token_counts(_documents(spark, folder)))


def p9_fullness(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fullness(p9_containers(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.equal_looking(_documents(spark, folder))


def p10_form(spark: SparkSession, folder: str) -> DataFrame:
    return visual.consistent_form(_documents(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    key = r"regexp_replace(lower(line), '[\s\x0b\x1c-\x1f\x85\pZ0-9]+', '', 'g')"
    return {
        "p1_found": f"""
            WITH docs AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE source IS NOT NULL),
            lines AS (SELECT doc_id, source, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM docs),
            keyed AS (SELECT doc_id, source, line_no, {key} AS k FROM lines),
            kept AS (SELECT * FROM keyed WHERE length(regexp_replace(k, '\\PL', '', 'g')) >= 10),
            sizes AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
            often AS (SELECT source, k FROM kept JOIN sizes USING (source) GROUP BY source, k, n
                HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.1 * n)
            SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM kept SEMI JOIN often USING (source, k)""",
        "p3_found": """
            SELECT DISTINCT tab, item FROM (SELECT 'documents' AS tab, CAST(doc_id AS VARCHAR) AS item, text FROM documents
            UNION ALL SELECT 'chunk_meta', chunk_id, texto FROM chunk_meta) WHERE length(text) > 2000""",
    }

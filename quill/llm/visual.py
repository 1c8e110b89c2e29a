"""One form for texts that look the same.

Arrow partitions are handed to an embedded DuckDB, whose SQL (translate, regexp_replace, nfc_normalize) maps
compatibility forms, kinds of space, invisible characters and look-alike letters. Every look-alike goes to the Latin
letter of the same shape, in any word of any language: only so are two texts that look equal always equal after it,
and letters without a Latin twin keep texts of other scripts apart. Texts are composed (NFC) before and after the letters
are mapped, and composed letters with a look-alike base are mapped by rule, so that canonically equal texts have one form.
Line ends are kept; CR LF and a lone CR are line ends like LF. Joiners stay after letters whose shape they change (Arabic,
Indic and South-East Asian scripts) and between pictographs.

Defined results: null stays null, an empty text stays empty; texts with equal code points are never a pair.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quill.session import written

#: Letters of other scripts and the Latin letters of the same shape.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ό": "ó", "Ό": "Ó",
    "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U", "օ": "o", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ս": "u",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S",
    "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Ligatures, digraphs and Roman numerals of one code point, and the letters that they show.
LIGATURES = {chr(cp): unicodedata.normalize("NFKC", chr(cp)) for first, last in ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB06)) for cp in range(first, last + 1)}
#: Kinds of space.
SPACES = "\t                 　"
#: Characters that show nothing, as a class of regular expressions: controls but LF and tab, format characters, fillers.
INVISIBLE = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]"
#: Full-width, half-width and styled (bold, script, double-struck) forms of one character.
WIDE = {c: plain for c in map(chr, range(0x80, 0x1F000)) if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>")) and len(plain := unicodedata.normalize("NFKC", c)) == 1 and plain != " "}
#: Letters after which a joiner changes the shape, and pictographs.
JOINED = r"[\x{600}-\x{8ff}\x{900}-\x{dff}\x{f00}-\x{fff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{1800}-\x{18af}\x{fe0f}\x{1f000}-\x{1faff}]"
#: What joiners that stay are in between (characters that no text holds).
KEPT = {"\u200c": "\ufdd0", "\u200d": "\ufdd1"}
#: Look-alikes as a translation table, for operators that compare words.
FOLD = str.maketrans(LOOKALIKES)
VISIBLE = 20
#: Copies up to which an equal text is listed document by document; of more, all but the first are paired with first documents only.
PAIRS_WITHIN = 64
#: Documents of a class above which its pairs are made in blocks.
BLOCK = 1024


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def composed_lookalikes() -> tuple[dict[str, str], dict[str, str]]:
    """Composed letters whose base has a Latin twin, and the twin with their marks: one code point, or several."""
    one, several = {}, {}
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in LOOKALIKES and unicodedata.normalize("NFC", c) == c:
            plain = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


@lru_cache(maxsize=1)
def form_sql() -> str:
    """SELECT of k, x and the consistent form of x, from a table t of k and x."""
    composed, several = composed_lookalikes()
    single = {c: LOOKALIKES.get(p, composed.get(p, p)) for c, p in WIDE.items()} | LOOKALIKES | composed | {c: " " for c in SPACES}
    begun = "regexp_replace(x, '\\r\\n?', chr(10), 'g')"
    for joiner, kept in KEPT.items():
        begun = f"regexp_replace({begun}, '({JOINED}){joiner}', '\\1{kept}', 'g')"
    begun = f"nfc_normalize(regexp_replace({begun}, {quoted(INVISIBLE)}, '', 'g'))"
    mapped = f"translate(y, {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    full = mapped
    for a, b in (LIGATURES | several).items():
        full = f"replace({full}, {quoted(a)}, {quoted(b)})"
    # of the texts with rare signs alone these many replacements are made
    mapped = f"CASE WHEN regexp_matches(y, '[{''.join(LIGATURES | several)}]') THEN {full} ELSE {mapped} END"
    form = f"translate(nfc_normalize({mapped}), {quoted(''.join(KEPT.values()))}, {quoted(''.join(KEPT))})"
    rest = f"SELECT k, x, {form} AS form FROM (SELECT k, x, {begun} AS y FROM t WHERE NOT regexp_full_match(x, '[\\x0a\\x20-\\x7e]*'))"
    return f"SELECT k, x, x AS form FROM t WHERE x IS NULL OR regexp_full_match(x, '[\\x0a\\x20-\\x7e]*') UNION ALL {rest}"


def _arrow_sql(select: str, names: list[str]):
    """A function for mapInArrow that runs SQL over table t of each batch in one embedded connection a task."""

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            if not batch.num_rows:
                continue
            con.register("t", pa.Table.from_batches([batch]))
            table = con.sql(select).to_arrow_table()
            con.unregister("t")
            yield from (b for b in table.cast(pa.schema([pa.field(n, pa.string() if pa.types.is_large_string(f.type) else f.type) for n, f in zip(names, table.schema)])).to_batches())
        con.close()

    return run


def consistent_form(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form string): each text in its consistent form."""
    kind = df.schema[key].dataType.simpleString()
    part = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    run = _arrow_sql(f"SELECT k, form FROM ({form_sql()})", ["k", "form"])
    return part.mapInArrow(run, f"k {kind}, form string").withColumnRenamed("k", key)


def form_digests(df: DataFrame, key: str = "doc_id", text: str = "text", visible: int = VISIBLE) -> DataFrame:
    """(key, form_id, text_id): digests of the form and of the text, of texts of enough visible characters."""
    kind = df.schema[key].dataType.simpleString()
    part = df.select(F.col(key).alias("k"), F.col(text).alias("x")).filter(F.length("x") >= visible)
    sql = f"""SELECT k, md5(form) AS form_id, CASE WHEN form = x THEN md5(form) ELSE md5(x) END AS text_id
        FROM ({form_sql()})
        WHERE length(form) >= 4 * {visible} OR length(regexp_replace(form, '\\s', '', 'g')) >= {visible}"""
    return part.mapInArrow(_arrow_sql(sql, ["k", "form_id", "text_id"]), f"k {kind}, form_id string, text_id string").withColumnRenamed("k", key)


def equal_looking(df: DataFrame, key: str = "doc_id", text: str = "text", within: int = PAIRS_WITHIN) -> DataFrame:
    """(doc_a, doc_b): pairs of texts that look the same but differ in code points.

    Digests alone are shuffled. Of each form with more than one text, all pairs of differing texts come out, for every
    document of a text; of a text that more than ``within`` documents share, all but the first document are paired only with
    the first documents of the other texts. Pairs of a form of many documents are made in blocks, spread over the tasks.
    """
    digests = written(form_digests(df, key, text), "forms")
    classes = digests.groupBy("form_id").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).filter("lo <> hi")
    members = written(digests.join(classes.select("form_id"), "form_id"), "looks")
    texts = members.groupBy("form_id", "text_id").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    sizes = texts.groupBy("form_id").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("n") <= within, F.col("n")).otherwise(1)).alias("listed"))

    def blocks(of: str):
        return F.ceil(F.col(of) / BLOCK).cast("int")

    known = members.join(texts, ["form_id", "text_id"]).join(sizes, "form_id").select("form_id", "text_id", F.col(key).alias("doc"), "n", "first", "size", "listed")
    known = known.withColumn("lead", F.col("doc") == F.col("first"))
    listed = known.filter((F.col("n") <= within) | F.col("lead")).withColumn("block", F.pmod(F.xxhash64("doc"), blocks("listed")).cast("int"))
    left = listed.select("form_id", F.col("doc").alias("x"), F.col("text_id").alias("text_x"), F.col("block").alias("i"), F.explode(F.sequence("block", blocks("listed") - 1)).alias("j"))
    right = listed.select("form_id", F.col("doc").alias("y"), F.col("text_id").alias("text_y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    pairs = left.join(right, ["form_id", "i", "j"]).filter("text_x <> text_y AND (i < j OR x < y)").select("x", "y")
    others = known.filter((F.col("n") > within) & ~F.col("lead")).select("form_id", F.col("doc").alias("x"), F.col("text_id").alias("text_x"), F.pmod(F.xxhash64("doc"), blocks("size")).cast("int").alias("i"))
    leads = known.filter("lead").select("form_id", F.col("doc").alias("y"), F.col("text_id").alias("text_y"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("i"))
    star = others.join(leads, ["form_id", "i"]).filter("text_x <> text_y").select("x", "y")
    both = pairs.unionByName(star).filter("x <> y")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

"""SQL for DuckDB with the results of the registered queries."""

from __future__ import annotations

from quill.operators.graph import TRIM
from quill.operators.segmenting import ABBREVIATIONS
from quill.sources.files import FORMATS

_SPACE = r"[\s\pZ]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\pZ\x0b\x1c-\x1f\x85]+'), lambda w: w <> '')"


def count_words(x: str) -> str:
    return f"coalesce(CAST(len({words(x)}) AS INTEGER), 0)"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\pL\pN]+')"


FIXED = r"fixed AS (SELECT doc_id, regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b-\x1f\x7f-\x9f]|\p{Cf}|\p{Co}', '', 'g') AS text FROM documents)"
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM fixed)"
STRIPPED = f"stripped AS (SELECT doc_id, i, line, {strip('line')} AS s FROM lines)"
REPEATED = "repeated AS (SELECT doc_id, s FROM stripped WHERE s <> '' AND length(s) <= 70 GROUP BY 1, 2 HAVING count(*) >= 4)"
NOISE = rf"(regexp_matches(s, '^[\s\pZ.\-–—•·|0-9]*$') OR (regexp_matches(s, '(?:{_SPACE}*\.{_SPACE}*){{3,}}') AND regexp_matches(s, '^[^\n]+\.{_SPACE}*\.{_SPACE}*\.{_SPACE}*[^\n]*\p{{Nd}}+{_SPACE}*$')))"
KEPT = rf"""kept AS (SELECT doc_id, i, {strip(rf"regexp_replace(regexp_replace(line, '(?:{_SPACE}*\.{_SPACE}*){{3,}}', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g')")} AS line
    FROM stripped ANTI JOIN repeated USING (doc_id, s) WHERE NOT {NOISE})"""


def dehyphenated(x: str) -> str:
    one = lambda y: rf"regexp_replace({y}, '([A-Za-zÀ-ÿ])-\n(\p{{Ll}})', '\1\2', 'g')"
    return one(one(x))


JOINED = "joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM kept WHERE line <> '' GROUP BY doc_id)"
CLEAN = rf"""clean AS (SELECT doc_id, CASE WHEN fixed.text IS NULL THEN NULL ELSE coalesce(trim(regexp_replace(replace({dehyphenated('joined.text')}, chr(10), ' '), '[ \t]{{2,}}', ' ', 'g')), '') END AS text
    FROM fixed LEFT JOIN joined USING (doc_id))"""
CLEANED = ", ".join([FIXED, LINES, STRIPPED, REPEATED, KEPT, JOINED, CLEAN])

_quotes = "[\"''”’)\\]]*"
_abbreviations = ", ".join(f"'{a}'" for a in ABBREVIATIONS)
SENTENCES = rf"""marked AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…])({_quotes}\s+)(["''“¿¡(\[]*[A-ZÀ-Ý0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS ps FROM clean WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM marked),
cutup AS (SELECT doc_id, i, CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 1) ELSE '' END AS gap, CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 2) ELSE p END AS body FROM pieces),
told AS (SELECT *, lower(rtrim(regexp_extract(body, '([\pL\pN\pM\p{{Pc}}.]+){_quotes}\s*$', 1), '.')) AS t FROM cutup),
flagged AS (SELECT *, t <> '' AND (t IN ({_abbreviations}) OR contains(t, '.') OR length(t) = 1 OR regexp_matches(t, '^\p{{Nd}}+$')) AS fb FROM told),
started AS (SELECT *, CASE WHEN i = 0 OR lag(fb) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS brk FROM flagged),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS sid FROM started),
glued AS (SELECT doc_id, sid, string_agg(CASE WHEN brk = 1 OR i = 0 THEN body ELSE gap || body END, '' ORDER BY i) AS sentence FROM numbered GROUP BY doc_id, sid),
sents AS (SELECT doc_id, {strip('sentence')} AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS n FROM glued WHERE {strip('sentence')} <> '')"""


def secondary(most: int) -> str:
    """CTEs: from src (id, s) to sec (id, k, part), texts cut at the first secondary mark whose parts all fit."""
    w = words("s")
    return f"""marks(m, mark) AS (VALUES (1, '•'), (2, '; '), (3, ': '), (4, ' | '), (5, ' – '), (6, ' — ')),
        pcs AS (SELECT id, m, list_filter(list_transform(string_split(s, mark), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM src JOIN marks ON contains(s, mark)),
        shreds AS MATERIALIZED (SELECT id, m, n, p, {count_words('p')} AS w FROM (SELECT id, m, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM pcs WHERE len(ps) >= 2)),
        heaps AS (SELECT id, m, n, p, w AS t, 0 AS g FROM shreds WHERE n = 0 UNION ALL
            SELECT x.id, x.m, x.n, x.p, CASE WHEN k.t + x.w > {most} THEN x.w ELSE k.t + x.w END, CASE WHEN k.t + x.w > {most} THEN k.g + 1 ELSE k.g END FROM heaps k JOIN shreds x ON x.id = k.id AND x.m = k.m AND x.n = k.n + 1),
        heaped AS (SELECT id, m, g, string_agg(p, ' ' ORDER BY n) AS part FROM heaps GROUP BY 1, 2, 3),
        fit AS (SELECT id, min(m) AS m FROM (SELECT id, m FROM heaped GROUP BY 1, 2 HAVING max({count_words('part')}) <= {most}) GROUP BY 1),
        wins AS (SELECT id, s, w, unnest(range(CASE WHEN len(w) <= {most} THEN 1 ELSE CAST(ceil(len(w) / {most}.0) AS BIGINT) END)) AS k FROM (SELECT id, s, {w} AS w FROM src ANTI JOIN fit USING (id))),
        sec AS (SELECT id, g AS k, part FROM heaped JOIN fit USING (id, m) UNION ALL SELECT id, k, CASE WHEN len(w) <= {most} THEN s ELSE array_to_string(w[k * {most} + 1:(k + 1) * {most}], ' ') END FROM wins)"""


def divided(most: int) -> str:
    """CTEs: from whole (doc_id, text) to out_parts (doc_id, n, part), whole sentences packed and overlong ones cut. To be used
    under WITH RECURSIVE."""
    return f"""clean AS (SELECT doc_id, text FROM whole WHERE {count_words('text')} > {most}), {SENTENCES},
        src AS (SELECT doc_id || '/' || n AS id, sentence AS s FROM sents WHERE {count_words('sentence')} > {most}), {secondary(most)},
        units AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i, part, alone, {count_words('part')} AS w FROM (
            SELECT doc_id, n, 0 AS k, sentence AS part, false AS alone FROM sents WHERE {count_words('sentence')} <= {most}
            UNION ALL SELECT doc_id, n, k, part, true FROM sents JOIN sec ON id = doc_id || '/' || n)),
        chain AS (SELECT doc_id, i, part, alone, w AS t, 0 AS g FROM units WHERE i = 1 UNION ALL
            SELECT u.doc_id, u.i, u.part, u.alone, CASE WHEN c.alone OR u.alone OR c.t + u.w > {most} THEN u.w ELSE c.t + u.w END, CASE WHEN c.alone OR u.alone OR c.t + u.w > {most} THEN c.g + 1 ELSE c.g END
            FROM chain c JOIN units u ON u.doc_id = c.doc_id AND u.i = c.i + 1),
        out_parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS n, part FROM (SELECT doc_id, g, {strip("string_agg(part, ' ' ORDER BY i)")} AS part FROM chain GROUP BY 1, 2) WHERE part <> ''
            UNION ALL SELECT doc_id, 0, {strip('text')} FROM whole WHERE {count_words('text')} <= {most})"""


def capped(most: int) -> str:
    w = words("sentence")
    return f"""capped AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS n, part FROM (
        SELECT doc_id, n, k, CASE WHEN len(w) <= {most} THEN sentence ELSE array_to_string(w[k * {most} + 1:(k + 1) * {most}], ' ') END AS part
        FROM (SELECT doc_id, n, sentence, w, unnest(range(CASE WHEN len(w) <= {most} THEN 1 ELSE CAST(ceil(len(w) / {most}.0) AS BIGINT) END)) AS k FROM (SELECT *, {w} AS w FROM sents))))"""


CHUNKS = "chunks AS (SELECT DISTINCT doc_id, chunk_id, fuente, formato, fenomeno, posicion, num_tokens, texto, chunk_uid, idioma, titulo, fecha FROM chunk_meta)"
FRAGMENTS = "frags AS (SELECT DISTINCT * FROM fragments)"
RANKINGS = f"""{FRAGMENTS}, per AS (SELECT query_id, chunk_id, min(rank) AS rank, max(length(text)) AS n FROM frags GROUP BY 1, 2),
longest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS r FROM per),
rankings AS (SELECT query_id, 0 AS source, CAST(rank AS BIGINT) AS rank, chunk_id AS item, (11 - rank) / 16.0::DOUBLE AS score FROM per
    UNION ALL SELECT query_id, 1, r, chunk_id, (11 - r) / 8.0::DOUBLE FROM longest WHERE r <= 6)"""


def fused(value: str) -> str:
    return f"""fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k = 1 THEN f.rank ELSE 0 END, score DESC, f.source, f.rank, item) AS rank, item, score FROM (
        SELECT query_id, item, k, min({{'source': source, 'rank': rank}}) AS f, round(CASE WHEN k = 1 THEN max(score) ELSE {value} END, 6) AS score
        FROM (SELECT r.*, k FROM rankings r JOIN (SELECT query_id, count(DISTINCT source) AS k FROM rankings GROUP BY 1) USING (query_id)) GROUP BY query_id, item, k))"""


def weight(of: dict[int, float]) -> str:
    return "CASE source " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in of.items()) + " ELSE 1.0 END"


def fuse(value: str) -> str:
    return f"WITH {RANKINGS}, {fused(value)} SELECT * FROM fused"


FUSED_DOCS = f"""{RANKINGS}, {fused('sum(1.0::DOUBLE / (60 + rank))')}, ofdoc AS (SELECT chunk_id, min(doc_id) AS doc_id FROM frags GROUP BY 1),
scored AS (SELECT query_id, rank, doc_id, score FROM fused JOIN ofdoc ON item = chunk_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS i FROM scored WHERE rank <= 30)"""


def aggregated(value: str) -> str:
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, doc_id) AS rank, doc_id, score
        FROM (SELECT query_id, doc_id, round({value}, 6) AS score, min(rank) AS f FROM placed GROUP BY 1, 2) QUALIFY rank <= 3"""


def agg(value: str) -> str:
    return f"WITH {FUSED_DOCS} {aggregated(value)}"


WEIGHTED = "sum(score / i) / sum(1.0::DOUBLE / i)"
CITED = f"""{FRAGMENTS}, cited AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank, doc_id FROM (SELECT query_id, doc_id, min(rank) AS r FROM frags GROUP BY 1, 2) QUALIFY rank <= 3),
paths AS (SELECT doc_code AS doc_id, fuente, coalesce(fenomeno, 0) AS fenomeno, source FROM documents),
grades AS (SELECT query_id, unnest(map_keys(relevantes)) AS fuente, unnest(map_values(relevantes)) AS grade FROM eval_queries)"""
GRADED = f"""{CITED}, one AS (SELECT * FROM frags QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY chunk_id, doc_id) = 1),
graded AS (SELECT one.query_id, one.rank, coalesce(grade, 0) AS grade FROM one LEFT JOIN paths USING (doc_id) LEFT JOIN grades ON grades.query_id = one.query_id AND grades.fuente = paths.fuente)"""
NDCG = f"""{CHUNKS}, pool AS (SELECT query_id, grade, n FROM grades JOIN (SELECT fuente, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1) USING (fuente) WHERE grade > 0),
spread AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM (SELECT query_id, grade, unnest(range(least(n, 10))) AS k FROM pool)),
best AS (SELECT query_id, sum(grade / log2(r + 1)) AS ideal FROM spread WHERE r <= 10 GROUP BY 1),
ndcg AS (SELECT query_id, round(CASE WHEN coalesce(ideal, 0) > 0 THEN got / ideal ELSE 0 END, 6) AS ndcg FROM (SELECT query_id, sum(grade / log2(rank + 1)) AS got FROM graded WHERE rank <= 10 GROUP BY 1) LEFT JOIN best USING (query_id))"""
F1 = """got AS (SELECT DISTINCT query_id, coalesce(fuente, '') AS item FROM cited LEFT JOIN paths USING (doc_id)),
want AS (SELECT DISTINCT query_id, fuente AS item FROM grades WHERE grade > 0),
f1 AS (SELECT query_id, round(CASE WHEN h > 0 THEN 2 * (h / 3.0) * (h / least(n, 3)::DOUBLE) / (h / 3.0 + h / least(n, 3)::DOUBLE) ELSE 0 END, 6) AS f1
    FROM (SELECT query_id, count(want.item) AS h FROM got LEFT JOIN want USING (query_id, item) GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n FROM want GROUP BY 1) USING (query_id))"""

_name = r"\p{Lu}[\pL\pM]+(?:[ -]\p{Lu}[\pL\pM]+)*"


def normal(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '[\s\pZ]+', ' ', 'g'), '{TRIM.replace(chr(39), chr(39) * 2)}'))"


FOUND = f"""{CHUNKS}, texts AS (SELECT DISTINCT chunk_id, doc_id, posicion, texto FROM chunks),
found AS (SELECT chunk_id, unnest(range(len(ns))) AS pos, unnest(ns) AS name FROM (SELECT chunk_id, regexp_extract_all(texto, '{_name}') AS ns FROM texts))"""
MENTIONS = f"""{FOUND}, mentions AS (SELECT chunk_id, name, min(place) AS pos FROM (SELECT chunk_id, {normal('name')} AS name, row_number() OVER (PARTITION BY chunk_id ORDER BY length(name) DESC, pos) AS place FROM found QUALIFY place <= 8) WHERE length(name) >= 3 GROUP BY 1, 2),
edges AS (SELECT a.name AS src, b.name AS dst, count(*) AS peso, min(a.chunk_id) AS chunk_id FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.pos < b.pos GROUP BY 1, 2)"""
NODES = f"""{MENTIONS}, heavy AS (SELECT * FROM edges WHERE peso >= 2), evidence AS (SELECT name, chunk_id FROM (SELECT DISTINCT name, chunk_id FROM mentions) QUALIFY row_number() OVER (PARTITION BY name ORDER BY chunk_id) <= 21),
node AS (SELECT DISTINCT name FROM (SELECT src AS name FROM heavy UNION ALL SELECT dst FROM heavy)),
keys AS (SELECT DISTINCT query_id, {normal('name')} AS key FROM (SELECT query_id, unnest(regexp_extract_all(text, '{_name}')) AS name FROM eval_queries)),
partly AS (SELECT query_id, key, name, CASE WHEN length(key) <= length(name) THEN key ELSE name END AS s, CASE WHEN length(key) <= length(name) THEN name ELSE key END AS l FROM keys ANTI JOIN node ON key = name JOIN node ON contains(key, name) OR contains(name, key) WHERE length(key) >= 4),
fitting AS (SELECT * FROM partly WHERE (instr(l, s) = 1 OR NOT regexp_matches(substr(l, instr(l, s) - 1, 1), '[\\pL\\pN]')) AND NOT regexp_matches(substr(l, instr(l, s) + length(s), 1), '[\\pL\\pN]')),
linked AS (SELECT query_id, key, name FROM keys JOIN node ON key = name WHERE key <> '' UNION ALL SELECT query_id, key, name FROM fitting QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY abs(length(name) - length(key)), name) = 1)"""

_formats = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMATS.items())
_extension = r"lower(regexp_extract(fuente, '[^/.][^/]*\.([^./]+)$', 1))"
INVENTORY = r"""inv AS (SELECT trim(replace(fuente, '\', '/'), '/') AS fuente, doc_id, coalesce(fenomeno, 0) AS fenomeno, nombre, observatorio, tipo, fenomeno AS raw FROM inventory),
listed AS (SELECT fuente, doc_id, fenomeno, nombre, observatorio, tipo FROM inv QUALIFY row_number() OVER (PARTITION BY fuente ORDER BY doc_id DESC NULLS LAST, nombre DESC NULLS LAST, tipo DESC NULLS LAST, observatorio DESC NULLS LAST, raw DESC NULLS LAST) = 1)"""
LAST = "last AS (SELECT * FROM (SELECT DISTINCT * FROM extraction_log) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY logged_at DESC, error ASC NULLS FIRST, n_chars DESC NULLS LAST) = 1)"

SQL: dict[str, str] = {
    "unicode_fix": f"WITH {FIXED} SELECT doc_id, text FROM fixed",
    "boilerplate_lines": f"WITH {FIXED}, {LINES}, {STRIPPED}, {REPEATED} SELECT doc_id, s AS line FROM repeated",
    "noise_lines": f"WITH {FIXED}, {LINES}, {STRIPPED} SELECT doc_id, CAST(i AS INTEGER) AS line_no FROM stripped WHERE {NOISE}",
    "clean_document": f"WITH {CLEANED} SELECT doc_id, text FROM clean",
    "dehyphenate": f"SELECT doc_id, {dehyphenated('text')} AS text FROM documents",
    "sentences": f"WITH {CLEANED}, {SENTENCES} SELECT doc_id, CAST(n AS INTEGER) AS n, sentence FROM sents",
    "sentence_cap": f"WITH {CLEANED}, {SENTENCES}, {capped(20)} SELECT doc_id, CAST(n AS INTEGER) AS n, part FROM capped",
    "chunk_pack": f"""WITH RECURSIVE {CLEANED}, {SENTENCES}, {capped(64)}, sized AS MATERIALIZED (SELECT doc_id, n, part, {count_words('part')} AS w FROM capped),
        walk AS (SELECT doc_id, n, w AS tokens, n AS a, -1 AS ea, -1 AS eb, 0 AS en, w AS lastw FROM sized WHERE n = 0
            UNION ALL SELECT s.doc_id, s.n, CASE WHEN k.tokens + s.w > 64 THEN k.lastw + s.w ELSE k.tokens + s.w END, CASE WHEN k.tokens + s.w > 64 THEN k.n ELSE k.a END,
                CASE WHEN k.tokens + s.w > 64 THEN k.a ELSE -1 END, k.n, k.tokens, s.w FROM walk k JOIN sized s ON s.doc_id = k.doc_id AND s.n = k.n + 1),
        ranges AS (SELECT doc_id, ea AS a, eb AS b, en AS t FROM walk WHERE ea >= 0 UNION ALL SELECT doc_id, a, n, tokens FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INTEGER) AS posicion, texto, CAST(t AS INTEGER) AS num_tokens FROM (
            SELECT r.doc_id, r.a, r.b, r.t, string_agg(s.part, ' ' ORDER BY s.n) AS texto FROM ranges r JOIN sized s ON s.doc_id = r.doc_id AND s.n BETWEEN r.a AND r.b GROUP BY 1, 2, 3, 4)""",
    "approx_tokens": f"WITH {FOUND} SELECT chunk_id, {count_words('texto')} AS n FROM texts",
    "filter_min_chars": f"""WITH {CHUNKS}, own AS (SELECT doc_id, chunk_id, coalesce(posicion, -1) AS posicion, texto FROM chunks WHERE texto IS NOT NULL),
        ranked AS (SELECT *, max(length(texto)) OVER (PARTITION BY doc_id) AS most, row_number() OVER (PARTITION BY doc_id ORDER BY length(texto) DESC, posicion) AS r FROM own)
        SELECT doc_id, chunk_id FROM ranked WHERE length(texto) >= 250 OR (most < 250 AND r = 1)""",
    "cap_per_doc": f"WITH {CHUNKS} SELECT doc_id, posicion FROM (SELECT DISTINCT doc_id, posicion FROM chunks) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY posicion NULLS FIRST) <= 3",
    "well_formed": rf"""WITH {FOUND} SELECT chunk_id, regexp_matches(texto, '^[\s\pZ]*[\p{{Lu}}\p{{Lt}}\p{{Nd}}¿¡"«“(\[•—]') AS opens, regexp_matches(texto, '[.!?"»”)\]…][\s\pZ]*$') AS closes FROM texts""",
    "chunk_ids": f"""WITH {CHUNKS} SELECT doc_id, posicion, CAST(row_number() OVER (ORDER BY doc_id, posicion) - 1 AS VARCHAR) AS chunk_id, printf('%s-chunk-%04d', doc_id, posicion) AS chunk_uid
        FROM (SELECT DISTINCT doc_id, posicion FROM chunks WHERE posicion IS NOT NULL)""",
    "l2_normalize": """SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x,
        sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings)""",
    "dense_topk": """SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""",
    "postings_build": f"WITH {FOUND} SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens('texto')}) AS token FROM texts) GROUP BY 1, 2",
    "sparse_topk": f"""WITH {FOUND}, tf AS (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens('texto')}) AS token FROM texts) GROUP BY 1, 2),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), terms AS (SELECT query_id, token, count(*) AS qw FROM (SELECT query_id, unnest({tokens('text')}) AS token FROM eval_queries) GROUP BY 1, 2),
        s AS (SELECT query_id, chunk_id, round(sum(qw * (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM texts)::DOUBLE / df)), 6) AS score FROM terms JOIN tf USING (token) JOIN df USING (token) GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "index_stats": f"WITH {FOUND}, t AS (SELECT chunk_id, unnest({tokens('texto')}) AS token FROM texts) SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT token) AS tokens, count(*) AS occurrences FROM t",
    "vector_store": "SELECT vec_id, label FROM embeddings",
    "fuse_combsum": fuse(f"sum({weight({0: 1.0, 1: 0.5})} * score)"),
    "fuse_combmnz": fuse(f"sum({weight({0: 1.0, 1: 0.5})} * score) * count(CASE WHEN score > 0 THEN 1 END)"),
    "fuse_rrf": fuse(f"sum({weight({0: 1.0, 1: 0.25})} / (60 + rank))"),
    "fuse_passthrough": f"WITH {RANKINGS} SELECT query_id, rank, item, score FROM rankings WHERE source = 1",
    "rerank": f"""WITH {FRAGMENTS}, one AS (SELECT * FROM frags QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, text) = 1),
        full_ AS (SELECT query_id, rank, chunk_id, list_distinct({tokens('q.text')}) AS qt, {tokens('one.text')} AS tt FROM one JOIN eval_queries q USING (query_id) WHERE rank <= 6)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, chunk_id AS item, score FROM (
            SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE round(len(list_filter(qt, lambda x: list_contains(tt, x))) / len(qt)::DOUBLE, 6) END AS score FROM full_)""",
    "agg_max_pool": agg("max(score)"),
    "agg_sum": agg("sum(score)"),
    "agg_weighted_mean": agg(WEIGHTED),
    "doc_centroid": """WITH hits AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, e.embedding, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
            FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 40),
        first5 AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) <= 5),
        m AS (SELECT query_id, label, dim, avg(x) AS x FROM (SELECT query_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM first5) GROUP BY 1, 2, 3)
        SELECT query_id, label, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY query_id, label)), 4) AS x FROM m""",
    "select_fragments": rf"""WITH {FRAGMENTS}, one AS (SELECT * FROM frags QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY chunk_id, doc_id, text) = 1),
        parts AS (SELECT query_id, rank, chunk_id, doc_id, {strip('text')} AS text FROM one WHERE {strip('text')} <> ''),
        firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY query_id, array_to_string({words('lower(text)')}, ' ') ORDER BY rank, chunk_id) = 1)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ({count_words('text')} < 20 OR NOT (regexp_matches(text, '^[\s\pZ]*[\p{{Lu}}\p{{Lt}}\p{{Nd}}¿¡"«“(\[•—]') AND regexp_matches(text, '[.!?"»”)\]…][\s\pZ]*$'))), rank, chunk_id) AS place,
            chunk_id, doc_id, text FROM firsts QUALIFY place <= 5""".replace("AS place", "AS rank_").replace("QUALIFY place", "QUALIFY rank_"),
    "entity_normalize": f"WITH {FOUND} SELECT chunk_id, CAST(pos AS INTEGER) AS pos, {normal('name')} AS name FROM found",
    "graph_build_simple": f"WITH {FOUND}, few AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pos) <= 8) SELECT a.name AS src, b.name AS dst, count(*) AS peso, min(a.chunk_id) AS chunk_id FROM few a JOIN few b ON a.chunk_id = b.chunk_id AND a.pos < b.pos GROUP BY 1, 2",
    "graph_build": f"WITH {MENTIONS} SELECT * FROM edges",
    "graph_nodes": f"WITH {NODES} SELECT name, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM evidence GROUP BY 1",
    "graph_prune": f"WITH {NODES} SELECT name, CAST(count(*) AS INTEGER) AS n FROM evidence JOIN node USING (name) GROUP BY 1",
    "entity_link": f"WITH {NODES} SELECT * FROM linked",
    "graph_topk": f"""WITH {NODES}, places AS (SELECT DISTINCT name, chunk_id FROM mentions), seeds AS (SELECT DISTINCT query_id, name FROM linked),
        near AS (SELECT query_id, other, coalesce(max(o), max(i)) AS peso, name FROM (SELECT query_id, name, dst AS other, peso AS o, NULL AS i FROM seeds JOIN heavy ON name = src UNION ALL SELECT query_id, name, src, NULL, peso FROM seeds JOIN heavy ON name = dst) GROUP BY query_id, name, other),
        w AS (SELECT query_id, name AS node_, 1.0::DOUBLE AS w FROM seeds UNION ALL SELECT query_id, other, 0.5 * (peso / 10.0::DOUBLE + 0.1) FROM near),
        s AS (SELECT query_id, chunk_id, round(sum(w), 6) AS score FROM w JOIN places ON node_ = places.name GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM s QUALIFY rank <= 20""",
    "dcg": f"WITH {GRADED} SELECT query_id, round(coalesce(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) END), 0), 6) AS dcg FROM graded GROUP BY 1",
    "ndcg": f"WITH {GRADED}, {NDCG} SELECT * FROM ndcg",
    "f1_at_3": f"WITH {CITED}, {F1} SELECT * FROM f1",
    "competition_rank": "SELECT source, score, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT source, round(avg(n_chars), 0) AS score FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "borda_points": "SELECT source, count(*) OVER () - rank() OVER (ORDER BY score DESC) AS points FROM (SELECT source, count(*) AS score FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "borda_leaderboard": """WITH a AS (SELECT source, count(*)::DOUBLE AS first FROM documents WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT source, count(DISTINCT titulo)::DOUBLE AS second FROM documents WHERE source IS NOT NULL AND idioma = 'es' GROUP BY 1),
        j AS (SELECT source, coalesce(first, 0) AS first, coalesce(second, 0) AS second FROM a FULL JOIN b USING (source)),
        p AS (SELECT *, count(*) OVER () - rank() OVER (ORDER BY first DESC) AS p1, count(*) OVER () - rank() OVER (ORDER BY second DESC) AS p2 FROM j)
        SELECT *, p1 + p2 AS total, row_number() OVER (ORDER BY p1 + p2 DESC, first DESC, source) AS place FROM p""",
    "evaluate": f"WITH {GRADED}, {NDCG}, {F1} SELECT count(*) AS queries, round(avg(ndcg), 5) AS mean_ndcg, round(avg(f1), 5) AS mean_f1 FROM ndcg FULL JOIN f1 USING (query_id)",
    "weak_labels": "SELECT printf('q%03d', dense_rank() OVER (ORDER BY query)) AS query_id, query, fuente, CAST(grade AS BIGINT) AS grade FROM (SELECT query, fuente, max(CASE WHEN rank_en_query <= 2 THEN 3 WHEN rank_en_query <= 4 THEN 2 ELSE 1 END) AS grade FROM manifest GROUP BY 1, 2)",
    "sweep": f"""WITH {FUSED_DOCS}, v AS (SELECT 'max_pool' AS variant, * FROM ({aggregated('max(score)')}) UNION ALL SELECT 'sum', * FROM ({aggregated('sum(score)')}) UNION ALL SELECT 'weighted_mean', * FROM ({aggregated(WEIGHTED)})),
        grades AS (SELECT query_id, unnest(map_keys(relevantes)) AS fuente, unnest(map_values(relevantes)) AS grade FROM eval_queries), want AS (SELECT DISTINCT query_id, fuente AS item FROM grades WHERE grade > 0),
        got AS (SELECT DISTINCT variant, query_id, coalesce(fuente, '') AS item FROM v LEFT JOIN (SELECT doc_code AS doc_id, fuente FROM documents) USING (doc_id)),
        f AS (SELECT variant, round(CASE WHEN h > 0 THEN 2 * (h / 3.0) * (h / least(n, 3)::DOUBLE) / (h / 3.0 + h / least(n, 3)::DOUBLE) ELSE 0 END, 6) AS f1 FROM (SELECT variant, query_id, count(want.item) AS h FROM got LEFT JOIN want USING (query_id, item) GROUP BY 1, 2) LEFT JOIN (SELECT query_id, count(*) AS n FROM want GROUP BY 1) USING (query_id)),
        m AS (SELECT variant, round(avg(f1), 5) AS f1 FROM f GROUP BY 1), sc AS (SELECT variant, round(avg(score), 5) AS score FROM v GROUP BY 1),
        p AS (SELECT *, count(*) OVER () - rank() OVER (ORDER BY f1 DESC) AS p1, count(*) OVER () - rank() OVER (ORDER BY score DESC) AS p2 FROM m JOIN sc USING (variant))
        SELECT *, p1 + p2 AS total, row_number() OVER (ORDER BY p1 + p2 DESC, f1 DESC, variant) AS place FROM p""",
    "validate_chunks": "SELECT chunk_id, error FROM (" + " UNION ALL ".join(
        [f"SELECT chunk_id, 'missing {c}' AS error FROM chunk_meta WHERE {c} IS NULL" for c in ["doc_id", "chunk_id", "fuente", "formato", "fenomeno", "posicion", "num_tokens", "texto"]]
        + ["SELECT chunk_id, 'bad fenomeno ' || CAST(fenomeno AS VARCHAR) FROM chunk_meta WHERE fenomeno NOT IN (1, 2, 3)", "SELECT chunk_id, 'bad posicion' FROM chunk_meta WHERE posicion < 0"]
    ) + ")",
    "validate_results": f"""WITH {CITED}, d AS (SELECT query_id, count(*) AS nd FROM cited GROUP BY 1), f AS (SELECT query_id, count(*) AS nf, max({count_words('text')}) AS w,
            bool_or(rank IS NULL OR chunk_id IS NULL OR doc_id IS NULL OR text IS NULL) AS broken FROM frags GROUP BY 1), j AS (SELECT * FROM d FULL JOIN f USING (query_id))
        SELECT query_id, 'documents: ' || coalesce(nd, 0) AS error FROM j WHERE coalesce(nd, 0) <> 3 UNION ALL SELECT query_id, 'fragments: ' || coalesce(nf, 0) FROM j WHERE coalesce(nf, 0) <> 10
        UNION ALL SELECT query_id, 'incomplete fragment' FROM j WHERE broken UNION ALL SELECT query_id, 'fragment too long' FROM j WHERE w > 250""",
    "validate_sequence": "SELECT * FROM (SELECT row_number() OVER (ORDER BY query_id) AS line, printf('q%03d', row_number() OVER (ORDER BY query_id)) AS expected, query_id AS found FROM (SELECT DISTINCT query_id FROM eval_queries)) WHERE expected <> found",
    "orphan_docs": f"WITH {CITED} SELECT DISTINCT doc_id FROM cited ANTI JOIN chunk_meta USING (doc_id)",
    "qa_coherence": f"WITH {CITED} SELECT query_id, wanted FROM (SELECT query_id, q.fenomeno AS wanted, count(CASE WHEN p.fenomeno = q.fenomeno THEN 1 END) AS hits FROM cited LEFT JOIN paths p USING (doc_id) JOIN eval_queries q USING (query_id) GROUP BY 1, 2) WHERE hits = 0",
    "qa_omnipresent": f"WITH {CITED} SELECT doc_id, n, n >= 10 AS flagged FROM (SELECT doc_id, count(*) AS n FROM cited GROUP BY 1) ORDER BY n DESC, doc_id LIMIT 5",
    "qa_mono_source": f"WITH {CITED} SELECT query_id FROM cited LEFT JOIN paths USING (doc_id) GROUP BY 1 HAVING count(DISTINCT coalesce(nullif(split_part(fuente, '/', 2), ''), '?')) = 1",
    "qa_fragments": f"WITH {FRAGMENTS}, w AS (SELECT text, {count_words('text')} AS w FROM frags) SELECT min(w) AS least, CAST(floor(sum(w) / count(*)::DOUBLE) AS BIGINT) AS mean, max(w) AS most, count(CASE WHEN w < 10 THEN 1 END) AS nearly_empty, count(text) - count(DISTINCT text) AS repeated FROM w",
    "ab_overlap": f"""WITH {CITED}, cb AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM (SELECT query_id, doc_id, max(rank) AS r FROM frags GROUP BY 1, 2) QUALIFY rank <= 3),
        da AS (SELECT query_id, list(doc_id ORDER BY rank) AS a FROM cited GROUP BY 1), db AS (SELECT query_id, list(doc_id ORDER BY rank) AS b FROM cb GROUP BY 1),
        fa AS (SELECT query_id, list_distinct(list(substr(text, 1, 120))) AS x FROM frags WHERE rank BETWEEN 1 AND 8 GROUP BY 1), fb AS (SELECT query_id, list_distinct(list(substr(text, 1, 120))) AS y FROM frags WHERE rank BETWEEN 3 AND 10 GROUP BY 1),
        c AS (SELECT query_id, a, b, x, y, len(list_intersect(a, b)) AS d, len(list_intersect(x, y)) AS f FROM da JOIN db USING (query_id) JOIN fa USING (query_id) JOIN fb USING (query_id))
        SELECT query_id, d AS common_docs, f AS common_fragments, a = b AS same_docs, f = len(x) AND f = len(y) AS same_fragments, d < len(a) OR f < len(x) AS changed FROM c""",
    "ab_indicators": f"""WITH {CITED}, j AS (SELECT cited.*, p.fenomeno, p.source, q.fenomeno AS wanted FROM cited LEFT JOIN paths p USING (doc_id) LEFT JOIN eval_queries q USING (query_id)),
        m AS (SELECT doc_id, count(*) AS n FROM j GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 1)
        SELECT round(count(CASE WHEN fenomeno = wanted THEN 1 END) / count(*)::DOUBLE, 6) AS coherence, count(DISTINCT doc_id) AS documents, (SELECT doc_id FROM m) AS most_cited, (SELECT n FROM m) AS n,
        (SELECT count(*) FROM (SELECT query_id FROM j GROUP BY 1 HAVING count(DISTINCT source) = 1)) AS mono_source FROM j""",
    "inventory_reader": f"WITH {INVENTORY} SELECT * FROM listed",
    "corpus_scan": f"WITH {INVENTORY}, f AS (SELECT fuente, {_extension} AS formato FROM documents) SELECT f.fuente, formato, doc_id, fenomeno FROM f JOIN listed USING (fuente) WHERE CASE formato {_formats} END IS NOT NULL",
    "corpus_scan_plain": f"""WITH f AS (SELECT fuente, {_extension} AS formato, row_number() OVER (ORDER BY fuente) - 1 AS i FROM documents WHERE fuente IS NOT NULL)
        SELECT fuente, formato, printf('DOC-%05d', i) AS doc_id, CASE WHEN regexp_matches(fuente, '^[Ff][0-9]') THEN CAST(substr(fuente, 2, 1) AS INTEGER) ELSE 0 END AS fenomeno FROM f WHERE CASE formato {_formats} END IS NOT NULL""",
    "format_detect": f"SELECT doc_id, CASE {_extension} {_formats} END AS logical, {_extension} AS extension FROM documents",
    "path_phenomenon": "SELECT doc_id, CASE WHEN regexp_matches(split_part(fuente, '/', 1), '^[Ff][0-9]') THEN CAST(substr(fuente, 2, 1) AS INTEGER) ELSE 0 END AS fenomeno FROM documents",
    "row_serialize": """SELECT p_partkey, nullif(concat_ws(' | ', CASE WHEN trim(p_name) <> '' THEN 'p_name: ' || trim(p_name) END, CASE WHEN trim(p_brand) <> '' THEN 'p_brand: ' || trim(p_brand) END,
        CASE WHEN trim(p_type) <> '' THEN 'p_type: ' || trim(p_type) END, CASE WHEN p_size IS NOT NULL THEN 'p_size: ' || p_size END), '') AS text FROM part""",
    "extraction_resume": "SELECT doc_code AS doc_id, fuente FROM documents WHERE doc_code NOT IN (SELECT doc_id FROM extraction_log WHERE error IS NULL AND n_chars > 0 AND doc_id IS NOT NULL)",
    "extraction_last": f"WITH {LAST} SELECT doc_id, n_chars, error FROM last",
    "scans_to_read": f"WITH {LAST} SELECT doc_id FROM last WHERE lower(formato) = 'pdf' AND error IS NULL AND coalesce(n_chars, 0) < 50",
    "jsonl_roundtrip": "SELECT query_id, text, idioma, fenomeno FROM eval_queries",
    "append_missing": f"SELECT doc_code AS doc_id FROM documents WHERE length({strip('text')}) > 0 AND doc_code NOT IN (SELECT doc_id FROM chunk_meta WHERE doc_id IS NOT NULL)",
    "migrate_ids": """SELECT old_id, CAST(row_number() OVER (ORDER BY doc_id, posicion) - 1 AS VARCHAR) AS chunk_id, printf('%s-chunk-%04d', doc_id, posicion) AS chunk_uid FROM (
        SELECT doc_id, posicion, min(chunk_id) AS old_id FROM chunk_meta WHERE posicion IS NOT NULL GROUP BY 1, 2)""",
}
# the place of a fragment is called rank, as its old rank is in the ordering
_numbered = "SELECT row_number() OVER () AS doc_id, chunk_id, texto AS text FROM texts"
SQL["split_secondary"] = f"""WITH RECURSIVE {FOUND}, rows_ AS MATERIALIZED ({_numbered}), src AS (SELECT doc_id AS id, text AS s FROM rows_ WHERE text IS NOT NULL), {secondary(25)}
    SELECT chunk_id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS n, part FROM sec JOIN rows_ ON doc_id = id
    UNION ALL SELECT chunk_id, 0, NULL FROM rows_ WHERE text IS NULL"""
SQL["split_output"] = f"""WITH RECURSIVE {FOUND}, rows_ AS MATERIALIZED ({_numbered}), whole AS (SELECT doc_id, text FROM rows_), {divided(40)}
    SELECT chunk_id, CAST(n AS INTEGER) AS n, part FROM out_parts JOIN rows_ USING (doc_id)"""
SQL["select_fragments_split"] = rf"""WITH RECURSIVE {FRAGMENTS}, one AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM frags QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY chunk_id, doc_id, text) = 1),
    whole AS (SELECT i AS doc_id, text FROM one), {divided(25)},
    parts AS (SELECT query_id, rank, chunk_id, one.doc_id, n, part AS text FROM one JOIN out_parts o ON o.doc_id = i WHERE part <> ''),
    firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY query_id, array_to_string({words('lower(text)')}, ' ') ORDER BY rank, n, chunk_id) = 1)
    SELECT query_id, place AS rank, chunk_id, doc_id, text FROM (SELECT query_id, chunk_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY ({count_words('text')} < 8
        OR NOT (regexp_matches(text, '^[\s\pZ]*[\p{{Lu}}\p{{Lt}}\p{{Nd}}¿¡"«“(\[•—]') AND regexp_matches(text, '[.!?"»”)\]…][\s\pZ]*$'))), rank, n, chunk_id) AS place FROM firsts) WHERE place <= 5"""
_kept = f"""packed AS ({SQL['chunk_pack']}), ranked AS (SELECT *, max(length(texto)) OVER (PARTITION BY doc_id) AS most, row_number() OVER (PARTITION BY doc_id ORDER BY length(texto) DESC, posicion) AS r FROM packed),
    kept AS (SELECT doc_id, posicion, texto, num_tokens FROM ranked WHERE length(texto) >= 40 OR (most < 40 AND r = 1))"""
_uid = "printf('%s-chunk-%04d', CAST(doc_id AS VARCHAR), posicion) AS chunk_uid"
SQL["build_index"] = f"WITH {_kept} SELECT *, CAST(row_number() OVER (ORDER BY doc_id, posicion) - 1 AS VARCHAR) AS chunk_id, {_uid} FROM kept"
SQL["append_documents"] = f"""WITH {_kept}, span AS (SELECT epoch(max(ingested_at))::BIGINT - floor((floor(epoch(max(ingested_at))) - floor(epoch(min(ingested_at)))) / 10) AS since FROM documents),
    late AS (SELECT doc_id, coalesce(floor(epoch(ingested_at)) >= since, false) AS late FROM documents, span)
    SELECT doc_id, posicion, num_tokens, CAST(row_number() OVER (ORDER BY late, doc_id, posicion) - 1 AS VARCHAR) AS chunk_id, {_uid} FROM kept JOIN late USING (doc_id)"""
SQL["sparse_store"] = SQL["postings_build"]
SQL["graph_store"] = f"WITH {NODES} SELECT * FROM heavy"
SQL["diverse_docs"] = """WITH hits AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, e.embedding, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 40),
    m AS (SELECT query_id, label, dim, avg(x) AS x FROM (SELECT query_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) <= 5)) GROUP BY 1, 2, 3),
    c AS (SELECT query_id, label, list(x ORDER BY dim) AS c FROM (SELECT query_id, label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY query_id, label)) AS x FROM m) GROUP BY 1, 2),
    firsts AS (SELECT query_id, label, max(score) AS score, min(rank) AS f FROM hits WHERE rank <= 30 GROUP BY 1, 2),
    pool AS (SELECT query_id, label, rank, c FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, label) AS rank FROM firsts) JOIN c USING (query_id, label) WHERE rank <= 18),
    near AS (SELECT a.query_id, a.rank AS a, b.rank AS b FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.rank < b.rank WHERE list_dot_product(a.c, b.c) >= 0.3),
    second AS (SELECT query_id, min(rank) AS rank FROM pool ANTI JOIN (SELECT query_id, b AS rank FROM near WHERE a = 1) USING (query_id, rank) WHERE rank > 1 GROUP BY 1),
    third AS (SELECT p.query_id, min(p.rank) AS rank FROM pool p JOIN second s ON p.query_id = s.query_id AND p.rank > s.rank WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.query_id = p.query_id AND n.b = p.rank AND n.a IN (1, s.rank)) GROUP BY 1),
    chosen AS (SELECT query_id, 1 AS rank FROM pool WHERE rank = 1 UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)
    SELECT query_id, place AS rank, label FROM (SELECT p.query_id, p.label, row_number() OVER (PARTITION BY p.query_id ORDER BY h.rank IS NULL, p.rank) AS place FROM pool p LEFT JOIN chosen h ON h.query_id = p.query_id AND h.rank = p.rank) WHERE place <= 3"""
SQL["validate_results"] = f"""WITH {CITED}, d AS (SELECT query_id, count(*) AS nd FROM cited JOIN paths USING (doc_id) WHERE fenomeno <> 0 GROUP BY 1),
    f AS (SELECT query_id, count(*) AS nf, max({count_words('text')}) AS w, bool_or(rank IS NULL OR chunk_id IS NULL OR doc_id IS NULL OR text IS NULL) AS broken FROM frags WHERE {count_words('text')} >= 30 GROUP BY 1), j AS (SELECT * FROM d FULL JOIN f USING (query_id))
    SELECT query_id, 'documents: ' || coalesce(nd, 0) AS error FROM j WHERE coalesce(nd, 0) <> 3 UNION ALL SELECT query_id, 'fragments: ' || coalesce(nf, 0) FROM j WHERE coalesce(nf, 0) <> 10
    UNION ALL SELECT query_id, 'incomplete fragment' FROM j WHERE broken UNION ALL SELECT query_id, 'fragment too long' FROM j WHERE w > 250"""
SQL["orphan_docs"] = f"WITH {CITED} SELECT DISTINCT doc_id FROM cited ANTI JOIN chunk_meta USING (doc_id) UNION ALL SELECT DISTINCT doc_id FROM chunk_meta ANTI JOIN paths USING (doc_id) WHERE doc_id IS NOT NULL"
SQL["qa_mono_source"] = f"WITH {CITED}, listed AS (SELECT query_id, fuente FROM cited LEFT JOIN paths USING (doc_id) UNION ALL SELECT query, fuente FROM manifest WHERE rank_en_query <= 10) SELECT query_id FROM listed GROUP BY 1 HAVING count(DISTINCT coalesce(nullif(split_part(fuente, '/', 2), ''), '?')) = 1"
_fields = ("doc_id", "chunk_id", "fuente", "formato", "fenomeno", "posicion", "texto")
SQL["package_check"] = f"""WITH {CITED}, {MENTIONS}, ids AS (SELECT DISTINCT chunk_id FROM chunk_meta WHERE chunk_id IS NOT NULL), v AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings),
    problems AS (SELECT 'chunks with a missing field' AS problem, count(*) AS n FROM chunk_meta WHERE {' OR '.join(f"{c} IS NULL OR trim(CAST({'substr(texto, 1, 1)' if c == 'texto' else c} AS VARCHAR)) = ''" for c in _fields)}
    UNION ALL SELECT 'chunks of unknown category', count(*) FROM chunk_meta WHERE fenomeno NOT IN (1, 2, 3) UNION ALL SELECT 'formats not in lower case', count(*) FROM chunk_meta WHERE formato <> lower(formato)
    UNION ALL SELECT 'chunk ids not ordinal', count(*) FROM ids WHERE coalesce(TRY_CAST(chunk_id AS BIGINT) NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM ids) OR CAST(TRY_CAST(chunk_id AS BIGINT) AS VARCHAR) <> chunk_id, true)
    UNION ALL SELECT 'chunks without vector', count(*) FROM ids ANTI JOIN v USING (chunk_id) UNION ALL SELECT 'vectors without chunk', count(*) FROM v ANTI JOIN ids USING (chunk_id)
    UNION ALL SELECT 'chunks of unknown documents', count(*) FROM (SELECT DISTINCT doc_id FROM chunk_meta) ANTI JOIN paths USING (doc_id) UNION ALL SELECT 'queries without result', count(*) FROM eval_queries ANTI JOIN cited USING (query_id)
    UNION ALL SELECT 'results of unknown queries', count(*) FROM (SELECT DISTINCT query_id FROM cited) ANTI JOIN eval_queries USING (query_id) UNION ALL SELECT 'cited documents without chunks', count(*) FROM (SELECT DISTINCT doc_id FROM cited) ANTI JOIN chunk_meta USING (doc_id)
    UNION ALL SELECT 'graphs without edges', CAST(count(*) = 0 AS BIGINT) FROM edges WHERE peso >= 2) SELECT * FROM problems WHERE n > 0"""
SQL["select_fragments"] = "SELECT query_id, rank_ AS rank, chunk_id, doc_id, text FROM (" + SQL["select_fragments"] + ")"

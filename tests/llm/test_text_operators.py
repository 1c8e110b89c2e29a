"""Repeated lines, splitting, sentences, tokens, packing and equal-looking texts on small tables."""

import random
import string

import pytest
from hypothesis import given, settings, strategies as st

from quill.llm import bpe, packing, repeated_lines, sentences, splitting, tokens, visual

DOCS = "doc_id bigint, source string, text string, key string, formato string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], DOCS)


# p1


def test_lines_repeated_within_a_source(spark):
    notice = "All rights reserved {} by the Observatory"
    rows = [(i, "a", f"Body number {chr(97 + i)} of this text\n{notice.format(2000 + i)}\nshare   THIS story now") for i in range(5)]
    rows += [(10, "b", notice.format(1)), (11, "b", "other"), (12, None, notice.format(3)), (13, "a", None), (14, "a", ""), (15, "a", "short 12\nshort 13\nshort")]
    found = {(r.doc_id, r.line_no) for r in repeated_lines.repeated_lines(docs(spark, rows)).collect()}
    assert found == {(i, n) for i in range(5) for n in (1, 2)}
    blocks = {r.block for r in repeated_lines.repeated_lines(docs(spark, rows)).collect()}
    assert len(blocks) == 1  # consecutive lines form one block
    clean = {r.doc_id: (r.text, r.removed) for r in repeated_lines.without_repeated_lines(docs(spark, rows)).collect()}
    assert clean[0] == ("Body number a of this text", 2) and clean[13] == (None, 0) and clean[14] == ("", 0) and clean[12][1] == 0
    assert len(clean) == len(rows)


def test_repeated_lines_by_brute_force(spark):
    import re
    from collections import defaultdict

    rng = random.Random(3)
    pool = [f"{rng.choice(['Terms', 'Cookies', 'About'])} {w * 4} 1{i}" for i, w in enumerate(["abc", "defg", "xyzw", "pq", "mnop"])]
    rows = [(i, rng.choice("abc"), "\n".join(rng.choice([*pool, f"unique line of {i} {''.join(rng.choices(string.ascii_letters, k=12))}", " "]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    key = lambda s: re.sub(r"[\s0-9]", "", s.lower())
    where = defaultdict(set)
    for i, s, t in rows:
        for line in t.split("\n"):
            where[s, key(line)].add(i)
    size = {s: sum(r[1] == s for r in rows) for s in "abc"}
    want = {(i, n) for i, s, t in rows for n, line in enumerate(t.split("\n")) if sum(c.isalpha() for c in line) >= 10 and len(where[s, key(line)]) >= max(3, 0.1 * size[s])}
    assert {(r.doc_id, r.line_no) for r in repeated_lines.repeated_lines(docs(spark, rows)).collect()} == want


def test_short_lines_belong_to_a_block_by_its_edges(spark, monkeypatch):
    rows = [(i, "a", f"Body number {chr(97 + i)} of this text\nSHARE\nAll rights reserved by the Observatory\n\n- x -\nBody ends {chr(110 + i)}\nNotes\nend of {chr(97 + i)}") for i in range(6)]
    rows += [(9, "a", "SHARE\nis a word of this text here\nNotes"), (10, None, "SHARE\nAll rights reserved by the Observatory")]
    clean = {r.doc_id: (r.text, r.removed) for r in repeated_lines.without_repeated_lines(docs(spark, rows)).collect()}
    # SHARE and the rule go with the notice they stand beside; Notes, as frequent but beside changing lines, and SHARE elsewhere stay
    assert clean[0] == ("Body number a of this text\n\nBody ends n\nNotes\nend of a", 3)
    assert clean[9] == (rows[6][2], 0) and clean[10] == (rows[7][2], 0)
    assert {(r.doc_id, r.line_no) for r in repeated_lines.repeated_lines(docs(spark, rows)).collect()} == {(i, 2) for i in range(6)}
    # without edges the notice is a block by itself
    whole = repeated_lines.blocks
    monkeypatch.setattr(repeated_lines, "blocks", lambda lines, nodes, share, least: whole(lines.limit(0), nodes, share, least))
    clean = {r.doc_id: (r.text, r.removed) for r in repeated_lines.without_repeated_lines(docs(spark, rows)).collect()}
    assert clean[0] == (rows[0][2].replace("All rights reserved by the Observatory\n", ""), 1)


def test_repeated_lines_of_an_empty_table(spark):
    assert repeated_lines.repeated_lines(docs(spark, [])).count() == 0


# p3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\n!。é", min_size=0, max_size=400), st.integers(20, 60))
def test_pieces_give_the_text_back(text, limit):
    _, starts = sentences.starts_of([text])
    out = splitting.pieces(text, starts, limit, limit // 4)
    assert "".join(text[b:e] for b, e, _ in out) == text
    assert all(e - b + s <= limit for b, e, s in out)
    assert all(s <= limit // 4 for _, _, s in out) and out[0][2] == 0


def test_oversized_items(spark):
    long = " ".join(f"Sentence number {i} says a few words." for i in range(200))
    rows = [(1, "s", long), (2, "s", "x" * 4500), (3, "s", "y" * 2000), (4, "s", None), (5, "s", ""), (1, "s", long)]
    out = splitting.split_oversized(docs(spark, rows), "doc_id").collect()
    assert {r.doc_id for r in out} == {1, 2}
    one = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.piece)
    assert all(len(r.text) <= 2000 for r in out) and len(one) % 2 == 0  # the repeated row has its own pieces
    assert all(r.text.rstrip().endswith(".") for r in one)
    assert all(r.shared > 0 and r.text.startswith("Sentence") for r in one if r.piece)


# p4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("El Dr. Pérez llegó. Nadie, p. ej. Ana, lo vio.", ["El Dr. Pérez llegó.", "Nadie, p. ej. Ana, lo vio."]),
        ("It grew by 3.5 percent. Really? Yes!", ["It grew by 3.5 percent.", "Really?", "Yes!"]),
        ('He said: "It is not enough. We need more." Then he left.', ['He said: "It is not enough. We need more."', "Then he left."]),
        ("„Das reicht nicht. Wir brauchen mehr“, sagte er. Am 22. März ging er.", ["„Das reicht nicht. Wir brauchen mehr“, sagte er.", "Am 22. März ging er."]),
        ("彼は「足りない。新しい。」と述べた。誰が来た？", ["彼は「足りない。新しい。」と述べた。", "誰が来た？"]),
        ("他说：“不够。还要。”谁来了？", ["他说：“不够。还要。”", "谁来了？"]),
        ("กระทรวงได้เลื่อนระบบ ดร.บาบามากล่าวว่า", ["กระทรวงได้เลื่อนระบบ", "ดร.บาบามากล่าวว่า"]),
        ("Heading\n• item one\nText... but no end", ["Heading", "• item one", "Text... but no end"]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_sentences(text, want):
    _, at = sentences.starts_of([text])
    at = at.tolist()
    assert [text[a:b].rstrip() for a, b in zip(at, [*at[1:], len(text)])] == want


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB .!\"“„”»«()\n。」「ที่ é1", max_size=700))
def test_scan_equals_the_sequential_run(text):
    import numpy as np

    classes = sentences.class_table()[np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)]
    nxt, _ = sentences.transducer()
    state, want = 0, []
    for c in classes.tolist():
        want.append(state)
        state = int(nxt[c * sentences.STATES + state])
    assert sentences.states_before(classes).tolist() == want


def test_sentences_of_a_table(spark):
    rows = [(1, None, "One. Two."), (2, None, None), (3, None, ""), (1, None, "One. Two.")]
    out = sorted((r.doc_id, r.idx, r.pos, r.sentence) for r in sentences.sentences(docs(spark, rows)).collect())
    assert out == sorted([(1, 0, 0, "One."), (1, 1, 5, "Two.")] * 2)


# p8


def reference_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_the_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    rows = df.select("doc_id", "text").collect()
    assert [got[r.doc_id] for r in rows] == reference_ids([r.text or "" for r in rows])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t aeiou's<|endoftext|>")), max_size=80))
def test_ids_of_any_text(text):
    e = bpe.encoder(bpe.vocabulary_path())
    offsets, ids = e.encode([text, None, ""])
    assert ids[: offsets[1]].tolist() == reference_ids([text])[0] and offsets[1] == offsets[2] == offsets[3]
    assert e.sizes_of([text, None]).tolist() == [offsets[1], 0]


def test_long_text_and_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    e = bpe.Encoder(bpe.vocabulary_path())
    text = "word " * 30_000 + "x" * 5000
    offsets, ids = e.encode([text])
    assert ids.tolist() == reference_ids([text])[0]
    offsets, ids = e.encode(["fresh words only"])
    assert ids.tolist() == reference_ids(["fresh words only"])[0]


# p9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit(sizes):
    placed, loads = packing.best_fit(sizes, 100)
    assert max(loads, default=0) <= 100 and sum(loads) == sum(sizes)
    assert all(sum(s for s, c in zip(sizes, placed.tolist()) if c == k) == loads[k] for k in range(len(loads)))


def filled(plan, counts):
    """Load of each container that a plan over counts makes."""
    load: dict[int, int] = {}
    for size, n in counts.items():
        own = sorted(p[1:] for p in plan if p[0] == size)
        for i in range(n):
            begin, container, each = max(p for p in own if p[0] <= i)
            load[container + (i - begin) // each] = load.get(container + (i - begin) // each, 0) + size
    return load


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=12))
def test_best_fit_on_counts(counts):
    load = filled(packing.best_fit_counts(counts, 100), counts)
    assert max(load.values(), default=0) <= 100 and sum(load.values()) == sum(s * n for s, n in counts.items())
    assert sorted(load) == list(range(len(load)))
    _, one_by_one = packing.best_fit([s for s, n in counts.items() for _ in range(n)], 100)
    assert len(load) <= len(one_by_one) + max(1, len(one_by_one) // 10)


def test_counts_of_any_number(spark):
    """More underfull containers than a task could hold are a few runs."""
    plan = packing.best_fit_counts({1100: 10**12, 900: 10**12, 40: 3 * 10**12}, 2048)
    assert len(plan) < 10


def test_fullness(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1100, 1100, 1100, 900, 40, 30, rng.randint(1, 2048)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint").repartition(23)
    packed = packing.pack(df)
    got = packing.fullness(packed).first()
    assert packed.count() == 6000 and got.held == sum(s for _, s in rows) and got.fullest <= 2048
    _, loads = packing.best_fit([s for _, s in rows], 2048)  # all in one place
    assert got.containers <= 1.01 * len(loads)
    assert packing.fullness(packing.pack(df.limit(0))).first().containers == 0


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, None, 5, 300, 1100, 2048, 2049, 5000, rng.randint(1, 2048)])) for i in range(400)] + [(7, 900), (7, 900), (None, 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint").repartition(9)
    out = packing.pack(df).collect()
    load: dict[str, int] = {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.size
    assert max(load.values()) <= packing.CAPACITY
    total = sum(s or 0 for _, s in rows)
    assert sum(r.size for r in out) == total
    full = [r for r in out if r.doc_id is not None]
    whole = {i: s or 0 for i, s in rows if i not in (7, None)}
    for i, s in whole.items():
        own = sorted((r for r in full if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == [k * 2048 for k in range(max(1, -(-s // 2048)))] and sum(r.size for r in own) == s
    assert sum(1 for v in load.values() if v) <= 1.1 * total / packing.CAPACITY + 20
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, size bigint")).count() == 0


# p10


def test_equal_looking(spark):
    base = "The panel measured the river agreement in Zamribor, official."
    rows = [
        (1, None, base),
        (2, None, base.replace("a", "а").replace("e", "е")),  # Cyrillic
        (3, None, base.replace(" ", " ").replace("ffi", "ﬃ")),
        (4, None, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base)),
        (5, None, base.replace("measured", "mea​su­red")),
        (6, None, base),
        (7, None, base.replace("agreement", "agréement")),
        (8, None, None), (9, None, ""), (10, None, "short а"), (11, None, "short a"),
        (12, None, base + "\nnext"),
    ]
    got = {(r.doc_a, r.doc_b) for r in visual.equal_looking(docs(spark, rows)).collect()}
    alike = [1, 2, 3, 4, 5, 6]
    assert got == {(a, b) for a in alike for b in alike if a < b} - {(1, 6)}
    linked = {(r.doc_a, r.doc_b) for r in visual.equal_looking(docs(spark, rows), within=2).collect()}
    assert linked <= got and {x for p in linked for x in p} == set(alike)
    forms = {r.doc_id: r.form for r in visual.consistent_form(docs(spark, rows)).collect()}
    assert forms[8] is None and forms[9] == "" and len({forms[i] for i in alike}) == 1 and forms[7] != forms[1]


def variants(n):
    """Texts of one look: the same words with Cyrillic letters in other places."""
    base = "The panel measured the river agreement in Zamribor, official."
    at = [i for i, c in enumerate(base) if c == "e"]
    return ["".join("е" if i in at and k >> at.index(i) & 1 else c for i, c in enumerate(base)) for k in range(n)]


def test_all_pairs_of_many_texts_of_one_look(spark, monkeypatch):
    rows = [(i, None, t) for i, t in enumerate(variants(100))]
    want = {(a, b) for a in range(100) for b in range(a + 1, 100)}
    for block in (visual.BLOCK, 16):
        monkeypatch.setattr(visual, "BLOCK", block)
        got = [(r.doc_a, r.doc_b) for r in visual.equal_looking(docs(spark, rows)).collect()]
        assert len(got) == len(want) and set(got) == want


def test_pairs_of_copied_texts_of_one_look(spark, monkeypatch):
    text = dict(enumerate(t for t, n in zip(variants(3), (50, 30, 20)) for _ in range(n)))
    rows = [(i, None, t) for i, t in text.items()]
    want = {(a, b) for a in text for b in text if a < b and text[a] != text[b]}
    got = [(r.doc_a, r.doc_b) for r in visual.equal_looking(docs(spark, rows)).collect()]
    assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(visual, "BLOCK", 16)
    few = [(r.doc_a, r.doc_b) for r in visual.equal_looking(docs(spark, rows), within=25).collect()]
    full, first = set(range(80, 100)), {0, 50, 80}
    allowed = full | first
    assert len(few) == len(set(few)) and set(few) == {(a, b) for a, b in want if {a, b} <= allowed or a in first or b in first}


def test_composed_and_decomposed_accents(spark):
    rows = [(1, None, "Comité académico de Vennegua y más"), (2, None, "Comité académico de Vennegua y más")]
    import unicodedata

    rows[1] = (2, None, unicodedata.normalize("NFD", rows[0][2]))
    assert [(r.doc_a, r.doc_b) for r in visual.equal_looking(docs(spark, rows)).collect()] == [(1, 2)]


def forms(spark, texts):
    rows = visual.consistent_form(docs(spark, [(i, None, t) for i, t in enumerate(texts)])).collect()
    return [r.form for r in sorted(rows, key=lambda r: r.doc_id)]


def test_canonically_equal_texts_have_one_form(spark):
    """Every code point below U+20000 that has a canonical decomposition, and the decomposition."""
    import unicodedata

    pairs = [(c, d) for c in map(chr, range(0x80, 0x20000)) if (d := unicodedata.normalize("NFD", c)) != c]
    assert len(pairs) > 12_000
    out = forms(spark, [f"ab{x}cd" for p in pairs for x in p])
    assert [p for p, a, b in zip(pairs, out[::2], out[1::2]) if a != b] == []
    assert forms(spark, out[:4000]) == out[:4000]


def test_line_ends_joiners_and_styled_letters(spark):
    same = [("a\r\nb", "a\nb"), ("a\rb", "a\nb"), ("￥100", "¥100"), ("ｶﾞ", "ガ"), ("𝐓𝐡𝐞 𝒫𝚕𝚊𝚗", "The Plan"), ("Ꮲlаn", "Plan"), ("օffice ofﬁce", "office office"), ("Ⅷ ĳ", "VIII ij"), ("ΆЎў", "Áў".replace("ў", "Y̆y̆")), ("pl\u200dan", "plan")]
    out = forms(spark, [x for p in same for x in p])
    assert out[::2] == out[1::2]
    other = [("a\rb", "ab"), ("می\u200cخواهم", "میخواهم"), ("क्\u200dष", "क्ष"), ("👨\u200d👩", "👨👩"), ("α", "a"), ("x²", "x2")]
    out = forms(spark, [x for p in other for x in p])
    assert all(a != b for a, b in zip(out[::2], out[1::2]))

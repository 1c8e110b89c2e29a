"""Literal cases and brute force for cleaning, segmentation, search, fusion, selection, graph and metrics."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.operators import evaluation as E, graph as G, ranking as R, segmenting as S
from quill.operators.joins import join_checked
from quill.operators.ordinals import with_ordinal
from quill.sources import files, stores
from quill.streaming import append


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_cleaning(spark):
    raw = "Contents ........ 21\nconges-\ntion of space-debris\nHEAD\nHEAD\nHEAD\nHEAD\n12\nx\x00y\x07z  twice"
    df = spark.createDataFrame([(1, raw), (2, None), (3, ""), (4, "\n\n")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in T.cleaned(df).collect()} == {1: "congestion of space-debris xyz twice", 2: None, 3: "", 4: ""}


def test_sentences(spark):
    cases = {
        "Hablo el Dr. Ramirez. Luego callo.": ["Hablo el Dr. Ramirez.", "Luego callo."],
        "Vino J. Perez. Ver Fig. 3 del texto.": ["Vino J. Perez.", "Ver Fig. 3 del texto."],
        "Una. Dos! Tres? Cuatro": ["Una.", "Dos!", "Tres?", "Cuatro"],
        'Dijo "hola." Luego salio.': ['Dijo "hola.', "Luego salio."],
        "Fue en 2026. Todo siguio.": ["Fue en 2026. Todo siguio."],
        "": [],
    }
    assert values(spark, list(cases), S.sentence_array) == list(cases.values())


def reference_pack(sizes, most, overlap):
    out, now, n = [], [], 0
    for i, k in enumerate(sizes):
        if now and n + k > most:
            out.append(list(now))
            now = now[-overlap:] if overlap else []
            n = sum(sizes[x] for x in now)
        now.append(i)
        n += k
    return out + ([now] if now else [])


def test_packing_by_brute_force(spark):
    rng = random.Random(2)
    rows = [[" ".join(["w"] * rng.randint(1, 9)) + "." for _ in range(rng.randint(0, 14))] for _ in range(40)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<string>")
    for most, overlap in [(12, 1), (12, 0), (10, 2)]:
        got = {r.i: [c.texto for c in r.p] for r in df.select("i", S.packed(F.col("s"), most, overlap).alias("p")).collect()}
        for i, s in enumerate(rows):
            assert got[i] == [" ".join(s[k] for k in chunk) for chunk in reference_pack([len(x.split()) for x in s], most, overlap)]


def test_output_parts(spark):
    bullets = "•".join(f" item {i} with five words" for i in range(40))
    run = " ".join(f"w{i}" for i in range(300))
    giant = "First one. Now " + "; ".join(f"part {i} of a list" for i in range(30)) + ". Last one."
    short = "Nothing to cut here."
    parts = values(spark, [bullets, run, giant, short, "", None], lambda c: S.output_parts(c, 60))
    assert all(len(p.split()) <= 60 for x in parts[:4] for p in x)
    assert len(values(spark, [run], lambda c: S.output_parts(c, 100))[0]) == 3
    assert " ".join(parts[1]).split() == run.split() and parts[3] == [short]
    assert parts[2][0] == "First one." and parts[2][-1] == "Last one."
    assert parts[4] == [""]


def test_capped_sentences_lose_no_word(spark):
    text = " ".join(f"campo{i}: valor{i}" for i in range(2000))
    parts = values(spark, [text], lambda c: S.capped(F.array(c), 256))[0]
    assert " ".join(parts) == text and max(len(p.split()) for p in parts) == 256


def test_kept_and_first_chunks(spark):
    df = spark.createDataFrame([("a", 0, "short"), ("a", 2, "x" * 100), ("b", 0, "tiny"), ("b", 1, "small"), ("b", 2, "large")], "doc_id string, posicion int, texto string")
    assert {(r.doc_id, r.posicion) for r in S.kept_chunks(df, 40).collect()} == {("a", 2), ("b", 1)}
    assert S.first_chunks(df, 1).count() == 2 and S.first_chunks(df, 0).count() == 5


def test_well_formed(spark):
    good, bad = ["Abre bien.", "¿Quién?", "• Item.", "2026 fue."], ["minuscula abre.", "No cierra", "", None]
    assert values(spark, good, T.well_formed) == [True] * 4 and not any(values(spark, bad, T.well_formed))


def test_ordinals_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = with_ordinal(df, ["k"], "n", 5).collect()
    assert sorted((r.k, r.n) for r in rows) == [(i, i + 5) for i in range(1000)]
    assert with_ordinal(df.filter("k < 0"), ["k"]).count() == 0


def test_checked_join_beyond_the_bound(spark):
    large = spark.createDataFrame([(i % 3, i) for i in range(300)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        few, many = (sorted(map(str, join_checked(large, small, ["k"], how, rows=n).collect())) for n in (10, 1))
        assert few == many


def test_broadcasts_are_bounded_by_bytes(spark):
    from quill.operators.joins import within_bounds

    df = spark.createDataFrame([(1, ["x" * 1000]), (2, None)], "k int, v array<string>")
    assert within_bounds(df) and not within_bounds(df, size=900) and not within_bounds(df, rows=1)


def test_join_of_hot_keys(spark):
    from quill.operators.joins import join_hot

    large = spark.createDataFrame([(0 if i % 2 else i, i, {"a": i}) for i in range(400)], "k int, v int, m map<string,int>")
    small = spark.createDataFrame([(i, f"w{i}") for i in (0, 0, 2, 4, 7)], "k int, w string")
    plain = sorted(map(str, large.join(small, "k").select("k", "v", "w").collect()))
    for rows in (7, 1000):
        assert sorted(map(str, join_hot(large, small, ["k"], rows).select("k", "v", "w").collect())) == plain
    assert len(join_checked(large, small.distinct(), ["k"], rows=1).collect()) == 203


RANK = "query_id string, source int, rank int, item string, score double"


def test_fusion(spark):
    df = spark.createDataFrame([("q", 0, 1, "a", 0.9), ("q", 0, 2, "b", 0.5), ("q", 1, 1, "b", 0.6), ("q", 1, 2, "c", 0.1), ("solo", 1, 1, "z", 7.0)], RANK)

    def order(method, weights=None):
        return {q: [(r.item, r.score) for r in sorted(R.fuse(df, method, weights).filter(F.col("query_id") == q).collect(), key=lambda r: r.rank)] for q in ("q", "solo")}

    assert order("combsum")["q"] == [("b", 1.1), ("a", 0.9), ("c", 0.1)]
    assert order("combmnz")["q"] == [("b", 2.2), ("a", 0.9), ("c", 0.1)]
    assert [i for i, _ in order("rrf")["q"]] == ["b", "a", "c"]
    assert order("rrf", {0: 1.0, 1: 0.0})["solo"] == [("z", 7.0)]


def test_weights_are_checked(spark):
    import pytest

    df = spark.createDataFrame([("q", 0, 1, "a", 0.9), ("q", 1, 1, "b", 0.6)], RANK)
    with pytest.raises(ValueError):
        R.fuse(df, "rrf", [1.0], sources=2)
    with pytest.raises(ValueError):
        R.checked_weights({0: "much"})
    with pytest.raises(Exception, match="no weight for source 1"):
        R.fuse(df, "rrf", {0: 1.0}).collect()
    assert R.checked_weights([1.0, 0.5], 2) == {0: 1.0, 1: 0.5} and R.checked_weights(None) is None


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aéB1 ..!?\"')(¿SrDr", max_size=60))
def test_both_sentence_splitters_agree(text):
    SEEN.append(" ".join(text.split()))


SEEN: list[str] = ["Hablo el Dr. Ramirez. Luego callo.", "Fue en 2026. Todo siguio.", 'Dijo "hola." Luego salio.', "e.g. One. al. Two ... Three… Four!) Five", "हिन्दी. Zwei. है. Drei", ""]


def test_sentence_expression_equals_the_arrow_function(spark):
    assert len(SEEN) > 20
    assert values(spark, SEEN, S.sentence_expression) == values(spark, SEEN, S.sentence_array)
    assert values(spark, [None], S.sentence_array) == [None]


def test_a_vector_of_another_dimension_is_an_error(spark, monkeypatch):
    import pytest

    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0, 1.0])], "vec_id bigint, embedding array<float>")
    for most in (R.QUERIES, 1):
        monkeypatch.setattr(R, "QUERIES", most)
        with pytest.raises(Exception, match="dimensions"):
            R.dense_top(df, df.filter("vec_id % 20 = 0"), 2).collect()
        assert R.dense_top(df.filter("vec_id <> 1"), df.filter("vec_id % 20 = 0"), 1).count() == 2


def test_both_ways_of_sparse_search_agree(spark, monkeypatch):
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(["la órbita_baja 2² café", "órbita y café", "हिन्दी पाठ", None, "baja baja órbita"])], "chunk_id string, texto string")
    queries = spark.createDataFrame([("q", "órbita baja café 2²"), ("h", "हिन्दी")], "query_id string, text string")
    few = sorted(map(str, R.sparse_top(chunks, queries, 5).collect()))
    monkeypatch.setattr(R, "TERMS", 0)
    assert few == sorted(map(str, R.sparse_top(chunks, queries, 5).collect())) and few


def test_search_passes_on_few_rows_a_task(spark, monkeypatch):
    """Blocks of a task are ranked together: it passes on the k best of a query, not the k best of every block."""
    for name, n in (("FIRST", 8), ("TEXTS", 16), ("BLOCK", 8)):
        monkeypatch.setattr(R, name, n, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    seen = []
    monkeypatch.setattr(R, "top", lambda df, k, by, order, name="rank", top=R.top: seen.append((df.count(), df.rdd.getNumPartitions())) or top(df, k, by, order, name))
    chunks = spark.createDataFrame([(f"{i:03}", "orbita " * (1 + i % 5) + f"baja{i % 7}") for i in range(200)], "chunk_id string, texto string")
    queries = spark.createDataFrame([("p", "orbita baja3"), ("q", "orbita baja3"), ("r", "baja1")], "query_id string, text string")
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 7), 1.0]) for i in range(200)], "vec_id bigint, embedding array<float>")
    try:
        sparse = {(r.query_id, r.rank): r.chunk_id for r in R.sparse_top(chunks, queries, 2).collect()}
        dense = {(r.query_id, r.rank): r.vec_id for r in R.dense_top(vectors, vectors.filter("vec_id < 3"), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(seen) == 2 and all(rows <= 3 * 2 * parts for rows, parts in seen)
    assert sparse == {("p", 1): "024", ("p", 2): "059", ("q", 1): "024", ("q", 2): "059", ("r", 1): "001", ("r", 2): "008"}
    s = {q: sorted(range(200), key=lambda i: (-(q % 5 * (i % 5) + q % 7 * (i % 7) + 1), i))[:2] for q in range(3)}
    assert dense == {(q, k + 1): i for q, x in s.items() for k, i in enumerate(x)}


def test_documents_of(spark):
    df = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.6), ("q", 3, "b", 0.6), ("q", 4, "c", 0.9)], "query_id string, rank int, doc_id string, score double")
    top = lambda m: [r.doc_id for r in sorted(R.documents_of(df, m).collect(), key=lambda r: r.rank)]
    assert top("max_pool") == ["a", "c", "b"] and top("sum") == ["b", "a", "c"] and top("weighted_mean") == ["a", "c", "b"]


def test_dense_top_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None)], "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in R.dense_top(df, df.filter("vec_id % 20 = 0"), 5).collect()}
    s = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    assert got == {(q, k + 1): int(i) for q in range(0, 90, 20) for k, i in enumerate(np.lexsort((np.arange(90), -s[q]))[:5])}


def test_approximate_search_recall(spark, folder):
    from quill.plans import registry

    exact = {(r.query_id, r.vec_id) for r in registry.dense_topk(spark, folder).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.dense_topk_cells(spark, folder).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_approximate_search_of_clustered_vectors_looks_into_few_cells(spark, folder):
    import numpy as np

    from quill.operators import approximate as A
    from quill.plans import registry

    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    fitted = A.fit(df)
    assert len(fitted.centres) == 54 and fitted.probes <= 12
    asked = df.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in R.dense_top(df, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in A.approximate_top(A.index(df, fitted), fitted, asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    large = folder.replace("sf0.001", "sf0.1")
    exact = {(r.query_id, r.vec_id) for r in registry.dense_topk(spark, large).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.dense_topk_cells(spark, large).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_clean_pages(spark):
    df = spark.createDataFrame([(1, ["one con-", "tinued page", "HEAD"]), (2, None)], "i int, pages array<string>")
    assert {r.i: r.text for r in T.cleaned_pages(df, "pages").collect()} == {1: "one continued page HEAD", 2: None}


def test_diverse_documents(spark):
    rows = [("q", 1, "a", [1.0, 0.0]), ("q", 2, "b", [1.0, 0.01]), ("q", 3, "c", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id string, rank int, doc string, centroid array<double>")
    assert [r.doc for r in sorted(R.diverse(df, "doc").collect(), key=lambda r: r.rank)] == ["a", "c", "b"]


def test_fragments(spark):
    words = " ".join(["palabra"] * 25)
    rows = [("q", 1, "1", "d", f"Uno {words}."), ("q", 2, "2", "d", f"uno  {words}."), ("q", 3, "3", "d", "Corto."), ("q", 4, "4", "d", f"Dos {words}.")]
    df = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, doc_id string, text string")
    assert [r.chunk_id for r in sorted(R.fragments_of(df).collect(), key=lambda r: r.rank)] == ["1", "4", "3"]


def test_graph(spark):
    mentions = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("2", 1, "a"), ("2", 2, "b"), ("3", 1, "b"), ("3", 2, "c")], "chunk_id string, pos int, name string")
    edges = G.simple_edges(mentions)
    assert {(r.src, r.dst, r.peso, r.chunk_id) for r in edges.collect()} == {("a", "b", 2, "1"), ("b", "c", 1, "3")}
    node = G.with_edges(G.nodes(mentions), G.pruned(edges))
    assert {r.name for r in node.collect()} == {"a", "b"}
    seeds = spark.createDataFrame([("q", "a")], "query_id string, name string")
    found = [(r.chunk_id, r.score) for r in sorted(G.graph_top(seeds, G.nodes(mentions), edges, 9).collect(), key=lambda r: r.rank)]
    assert found == [("1", 1.15), ("2", 1.15), ("3", 0.15)]


def test_every_chunk_of_a_name_counts(spark, monkeypatch):
    """Names of more chunks than a node keeps as evidence: the best chunks may be the last ones."""
    n = 3 * G.EVIDENCE
    mentions = spark.createDataFrame([(f"{i:03}", 1, "a") for i in range(n)] + [(f"{i:03}", 2, "b") for i in range(n - 2, n)] + [("x", 1, "b")], "chunk_id string, pos int, name string")
    edges = G.pruned(G.simple_edges(mentions))
    seeds = spark.createDataFrame([("q", "a"), ("r", "a"), ("both", "a"), ("both", "b")], "query_id string, name string")
    for most in (G.NEAR, 1):
        monkeypatch.setattr(G, "NEAR", most)
        got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in G.graph_top(seeds, mentions.select("name", "chunk_id"), edges, 3).collect()}
        first = {1: (f"{n - 2:03}", 1.15), 2: (f"{n - 1:03}", 1.15), 3: ("000", 1.0)}
        both = {1: (f"{n - 2:03}", 2.3), 2: (f"{n - 1:03}", 2.3), 3: ("000", 1.15)}
        assert got == {(q, k): v for q, rows in (("q", first), ("r", first), ("both", both)) for k, v in rows.items()}


def test_entity_linking(spark):
    node = spark.createDataFrame([("orbita baja terrestre",), ("kessler",), ("orbitabaja",)], "name string")
    keys = spark.createDataFrame([("q", "kessler"), ("q", "orbita baja"), ("q", "baj"), ("q", "efecto kessler")], "query_id string, key string")
    assert {(r.key, r.name) for r in G.linked(keys, node).collect()} == {("kessler", "kessler"), ("orbita baja", "orbita baja terrestre"), ("efecto kessler", "kessler")}


def test_metrics(spark):
    import math

    graded = spark.createDataFrame([("q", 1, 3), ("q", 2, 2), ("q", 3, 3)], "query_id string, rank int, grade int")
    want = 3 + 2 / math.log2(3) + 3 / 2
    assert E.dcg(graded).collect()[0].dcg == round(want, 6)
    pool = spark.createDataFrame([("q", 3, 2), ("q", 2, 1)], "query_id string, grade int, n bigint")
    assert E.ndcg(graded, pool).collect()[0].ndcg == round(want / (3 + 3 / math.log2(3) + 2 / 2), 6)
    got = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "x"), ("none", "y")], "query_id string, item string")
    rel = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item string")
    assert {r.query_id: r.f1 for r in E.f1_at_3(got, rel).collect()} == {"q": 0.8, "none": 0.0}


def test_borda(spark):
    a = spark.createDataFrame([("w", 0.9), ("x", 0.8), ("y", 0.8), ("z", 0.1)], "team string, ndcg double")
    b = spark.createDataFrame([("w", 0.5), ("x", 0.6), ("y", 0.4)], "team string, f1 double")
    out = {r.team: (r.p1, r.p2, r.total, r.place) for r in E.borda_leaderboard(a, b, "team", "ndcg", "f1").collect()}
    assert out == {"w": (3, 2, 5, 1), "x": (2, 3, 5, 2), "y": (2, 1, 3, 3), "z": (0, 0, 0, 4)}


def test_result_checks(spark):
    kind = "query_id string, documents array<struct<rank:int,doc_id:string>>, fragments array<struct<rank:int,chunk_id:string,doc_id:string,text:string>>"
    fine = ("q1", [(i, "d") for i in (1, 2, 3)], [(i, "c", "d", "text") for i in range(1, 11)])
    rows = [fine, ("q2", fine[1][:2], fine[2][:9] + [(10, "c", "d", "w " * 251)]), ("q3", None, None), ("q4", [(1, None), *fine[1][1:]], fine[2])]
    got = {(r.query_id, r.error) for r in E.result_errors(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("q2", "documents: 2"), ("q2", "fragment too long"), ("q3", "documents: 0"), ("q3", "fragments: 0"), ("q4", "incomplete document")}


def test_json_harvest():
    raw = '{"body": ["text one", "text one", {"n": 3, "flag": true}], "url": "skip me", "title": "The title", "x": "http://no", "y": "ab"}'
    assert files.harvest_json(raw) == "The title\n\ntext one\n\nn: 3\n\nflag: True"
    assert files.harvest_json("{broken") == "" and files.harvest_json(None) == ""


def test_pages_and_tables():
    assert files.page_text("<html><head><title>no</title></head><body><nav>no</nav><h1>A &amp; b</h1><p>c<br>d</p><script>no</script></body>") == "A & b\nc\nd"
    assert files.csv_text("a;b\n1;\n;nan\n2;x\n") == "a: 1\na: 2 | b: x"


def test_extract_files(spark, tmp_path):
    (tmp_path / "F2_X").mkdir()
    (tmp_path / "F2_X" / "a.txt").write_bytes(b"caf\xc3\xa9 \xff.")
    (tmp_path / "F2_X" / "b.json").write_text('{"title": "The title"}')
    (tmp_path / "c.jpg").write_bytes(b"x")
    (tmp_path / "d.unknown").write_bytes(b"x")
    listed = files.scan(files.listing(spark, str(tmp_path)).select(files.posix("fuente").alias("fuente")))
    assert {(r.fuente, r.doc_id, r.fenomeno) for r in listed.collect()} == {("F2_X/a.txt", "DOC-00000", 2), ("F2_X/b.json", "DOC-00001", 2), ("c.jpg", "DOC-00002", 0)}
    raw = spark.createDataFrame([("a.txt", b"caf\xc3\xa9 \xff."), ("b.json", b'{"title": "The title"}'), ("c.jpg", b"x"), ("e.md", None)], "fuente string, content binary")
    out = {r.fuente: (r.text, r.error) for r in files.extract(raw).collect()}
    assert out["a.txt"] == ("café .", None) and out["b.json"] == ("The title", None) and out["c.jpg"] == ("", None) and out["e.md"][0] == "" and out["e.md"][1]


def test_a_scan_sends_no_inventory_to_the_driver(spark):
    listed = spark.createDataFrame([("F1_X/a.txt",), ("F1_X/b.pdf",), ("c.unknown",)], "fuente string")
    known = spark.createDataFrame([("F1_X/a.txt", "A", 1), ("F1_X/z.txt", "Z", 1)], "fuente string, doc_id string, fenomeno int")
    found = files.scan(listed, known)
    assert [tuple(r) for r in found.collect()] == [("F1_X/a.txt", "txt", "A", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stores(spark, tmp_path):
    postings = spark.createDataFrame([("orbita", "1", 2), ("kessler", "2", 1)], "token string, chunk_id string, tf int")
    stores.save_postings(postings, str(tmp_path / "p"))
    assert [r.chunk_id for r in stores.load_postings(spark, str(tmp_path / "p"), ["orbita"]).collect()] == ["1"]
    node, edge = spark.createDataFrame([("a", ["1"])], "name string, chunks array<string>"), spark.createDataFrame([("a", "b", 2)], "src string, dst string, peso int")
    stores.save_graph(node, edge, str(tmp_path / "g"))
    assert [x.count() for x in stores.load_graph(spark, str(tmp_path / "g"))] == [1, 1]


def test_append(spark, tmp_path):
    docs = spark.createDataFrame([("a", "text"), ("b", " "), ("c", "more"), ("d", None)], "doc_id string, text string")
    indexed = spark.createDataFrame([("a",)], "doc_id string")
    assert [r.doc_id for r in append.missing(docs, indexed).collect()] == ["c"]
    chunks = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y")], "doc_id string, posicion int, texto string")
    assert {(r.chunk_id, r.chunk_uid) for r in append.appended(chunks, 7).collect()} == {("7", "c-chunk-0000"), ("8", "c-chunk-0001")}
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = append.append_stream(stream, lambda df, n: seen.extend(r.doc_id for r in append.missing(df, indexed).collect()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert seen == ["c"]


@settings(max_examples=25, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=6), x, max_size=3), max_leaves=12))
def test_json_harvest_of_any_value(value):
    import json

    assert isinstance(files.harvest_json(json.dumps(value)), str)

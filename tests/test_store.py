"""Index stores, encoders, workbooks, tiles and the session on small inputs."""

import io
import zipfile

import numpy as np
import pytest

from quill.operators import encoding
from quill.plans import pipeline, store
from quill.sources import files, stores, tables, tiles

DOCS = [(i, f"The council measured river {i} again. It published the plan of Zamribor. Nobody in Narzara read it, said the panel." * 2) for i in range(6)]
OPTIONS = pipeline.Options(max_tokens=16, min_chunk_chars=10, dimensions=8)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_append_goes_on_and_adds_nothing_twice(spark, tmp_path):
    folder = str(tmp_path / "index")
    every = documents(spark, [*DOCS, (7, None), (8, " ")])
    store.build(every.filter("doc_id < 4"), folder, OPTIONS)
    old = spark.read.parquet(f"{folder}/chunks").count()
    planned = store.append_documents(every, folder, OPTIONS, dry_run=True)
    assert planned[1] == 2 and spark.read.parquet(f"{folder}/chunks").count() == old
    assert store.append_documents(every, folder, OPTIONS) == planned
    assert store.append_documents(every, folder, OPTIONS) == (0, 0)
    ids = sorted((int(r.chunk_id), r.doc_id) for r in spark.read.parquet(f"{folder}/chunks").collect())
    assert [n for n, _ in ids] == list(range(old + planned[0])) and {d for n, d in ids if n >= old} == {4, 5}
    assert store.misaligned(spark, folder).count() == 0


def test_an_interrupted_append_and_build_are_completed(spark, tmp_path):
    folder, whole = str(tmp_path / "a"), str(tmp_path / "b")
    every = documents(spark, DOCS)
    store.build(every, whole, OPTIONS)
    store.build(every.filter("doc_id < 4"), folder, OPTIONS)
    new = spark.read.parquet(f"{whole}/chunks").filter("doc_id >= 4")
    new.write.mode("append").parquet(f"{folder}/chunks")  # as if killed before vectors and postings
    assert {r.problem for r in store.misaligned(spark, folder).collect()} == {"chunks without vector"}
    assert store.append_documents(every, folder, OPTIONS) == (0, 0)
    assert store.misaligned(spark, folder).count() == 0
    rows = lambda name, f: sorted(map(str, (stores.load_postings(spark, f"{f}/postings") if name == "postings" else spark.read.parquet(f"{f}/{name}")).collect()))
    assert rows("postings", folder) == rows("postings", whole) and rows("vectors", folder) == rows("vectors", whole)
    import shutil

    shutil.rmtree(f"{whole}/nodes")
    store.build(documents(spark, []), whole, OPTIONS)  # what is finished is kept
    assert rows("chunks", whole) and rows("nodes", whole)


def test_renumbering(spark, tmp_path):
    folder = str(tmp_path / "index")
    store.build(documents(spark, DOCS), folder, OPTIONS)
    want = sorted(map(str, stores.load_postings(spark, f"{folder}/postings").collect()))
    for name in ("chunks", "vectors"):
        old = spark.read.parquet(f"{folder}/{name}").selectExpr("*", "concat('x', chunk_id) AS c").drop("chunk_id").withColumnRenamed("c", "chunk_id").collect()
        spark.createDataFrame(old, spark.read.parquet(f"{folder}/{name}").select(*[c for c in spark.read.parquet(f"{folder}/{name}").columns if c != "chunk_id"], "chunk_id").schema).write.mode("overwrite").parquet(f"{folder}/{name}")
    terms = stores.load_postings(spark, f"{folder}/postings").selectExpr("token", "concat('x', chunk_id) AS chunk_id", "tf").collect()
    stores.save_postings(spark.createDataFrame(terms, "token string, chunk_id string, tf bigint"), f"{folder}/postings")
    assert {r.problem for r in store.misaligned(spark, folder).collect()} == {"chunk ids not ordinal"}
    store.renumber(folder, spark)
    assert store.misaligned(spark, folder).count() == 0
    assert sorted(map(str, stores.load_postings(spark, f"{folder}/postings").collect())) == want


def test_vectors_are_checked_before_they_are_added(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    stores.save_vectors(make([("0", [1.0, 0.0])]), path)
    for wrong in ([("1", [1.0])], [("0", [0.0, 1.0])], [("2", [0.0, 1.0]), ("2", [1.0, 0.0])], [(None, [0.0, 1.0])], [("3", [])]):
        with pytest.raises(ValueError):
            stores.add_vectors(make(wrong), path)
    stores.add_vectors(make([("1", [0.0, 1.0])]), path)
    stores.add_vectors(make([]), path)
    assert stores.load_vectors(spark, path).count() == 2
    assert stores.load_postings(spark, str(tmp_path / "none")) is None


def test_encoders():
    e = encoding.encoder("hashed", dimensions=16, query_prefix="query: ", passage_prefix="passage: ")
    a, b = e.encode(["river plan", None, ""]), e.encode(["river plan"], is_query=True)
    assert a.dtype == np.float32 and np.allclose(np.linalg.norm(a, axis=1), 1) and not np.allclose(a[0], b[0])
    assert np.allclose(b[0], encoding.encoder("other", dimensions=16).encode(["query: river plan"])[0])
    encoding.register("test-m3", lambda name, **_: encoding.Encoder(name, 3, lambda texts: np.zeros((len(texts), 2))))
    try:
        with pytest.raises(ValueError):
            encoding.encoder("some/test-m3-large").encode(["x"])
        assert encoding.encoder("some/test-m3-large").encode([]).shape[0] == 0
    finally:
        del encoding._factories["test-m3"]


def workbook(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="http://r"><sheets><sheet name="a" r:id="rId2"/><sheet name="b" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="m"><sheetData>{cells}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData/></worksheet>')
    return out.getvalue()


def test_workbooks(spark):
    head = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>third</t></is></c></row>'
    book = workbook(f'{head}<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c></row><row><c r="B3"><v>nan</v></c></row><row><c r="C4" t="b"><v>1</v></c></row>')
    assert tables.workbook_text(book) == "name: two runs | third: 3.5\nthird: True"
    assert tables.workbook_text(workbook("")) == ""
    raw = spark.createDataFrame([("a.xlsx", book), ("b.xlsx", b"no zip")], "fuente string, content binary")
    out = {r.fuente: (r.text, r.error) for r in files.extract(raw).collect()}
    assert out["a.xlsx"][0].startswith("name: two runs") and out["b.xlsx"][0] == "" and out["b.xlsx"][1]


def field(number, wire, body):
    return bytes([number << 3 | wire]) + (bytes([len(body)]) + body if wire == 2 else body)


def test_tiles():
    import struct

    values = [field(1, 2, "río".encode()), field(3, 1, struct.pack("<d", 2.5)), field(4, 0, b"\xff" * 9 + b"\x01"), field(6, 0, b"\x05"), field(7, 0, b"\x01"), field(1, 2, b" ")]
    layer = field(1, 2, b"zones") + b"".join(field(3, 2, k) for k in (b"name", b"size", b"n", b"z", b"on", b"none"))
    layer += b"".join(field(4, 2, v) for v in values)
    tags = bytes(x for i in range(6) for x in (i, i))
    layer += field(2, 2, field(2, 2, tags)) * 2 + field(2, 2, field(3, 0, b"\x01"))
    assert tiles.tile_text(field(3, 2, layer)) == "capa zones | name: río | size: 2.5 | n: -1 | z: -3 | on: True."
    assert tiles.tile_text(b"") == ""
    with pytest.raises((ValueError, IndexError)):
        tiles.tile_text(b"\x1a\x7fshort")


def test_written_tables_are_removed(spark):
    from quill import session

    path_of = lambda df: df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    path = path_of(session.written(spark.range(3), "gone"))
    assert session.exists(spark, path)
    session.drop_written(spark)
    assert not session.exists(spark, path)

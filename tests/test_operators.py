"""Search, export, sources, state and the stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions.stem import porter
from foliant.operators import export, regions, search, state
from foliant.operators.structure import parse_structure
from foliant.sources import files
from foliant.streaming import intake as stream


def docs(spark):
    rows = [(1, "Blood glucose is high. Glucose again.", "2024-01-01"), (2, "glucose", "2024-01-02"), (3, None, "2024-01-03"), (4, "Running runs", "2024-01-04"), (5, "glucose", "2024-01-02")]
    return spark.createDataFrame(rows, "doc_id int, text string, created_at string")


def test_search(spark):
    ids = lambda q, **k: [r["doc_id"] for r in search.search(docs(spark), q, **k).collect()]
    assert ids("the GLUCOSE") == [1, 2, 5]
    assert ids("glucose", limit=1, offset=1) == [2]
    assert ids("of the") == ids("absent") == []
    assert ids("run", stemmed=True) == [4]
    assert all(0 < r["rank"] < 1 for r in search.search(docs(spark), "glucose").collect())
    for bad in (("", 1, 0), ("q", 0, 0), ("q", 101, 0), ("q", 1, -1)):
        with pytest.raises(ValueError):
            search.check_page(*bad)


def test_search_stemmed_and_postings(spark, small):
    """Stemmed search and searches over postings against plain counting of all documents."""
    import collections
    import re

    from foliant.plans import catalog

    rows = catalog._records(spark, small).select("doc_id", "text", "created_at", "source").collect()
    docs = spark.createDataFrame(rows)
    stops = set(search.stop_words(spark))
    for query, stemmed in (("works licensing", True), ("possibly happy filings", True), ("license", True), ("clown worthless", False), ("the", True), ("x", True)):
        f = porter if stemmed else (lambda w: w)
        terms = sorted({f(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in stops})
        expected = []
        for r in rows:
            n = collections.Counter(f(w) for w in re.findall(r"[^\W_]+", (r["text"] or "").lower()) if w not in stops)
            if terms and all(n[t] for t in terms):
                expected.append((-round(sum(n[t] / (n[t] + 1) for t in terms), 6), -r["created_at"].timestamp(), r["doc_id"]))
        wanted = [x[2] for x in sorted(expected)[:50]]
        index = search.postings(docs, stemmed)
        for got in (search.search(docs, query, 50, stemmed=stemmed), search.search_postings(index, docs.drop("text"), query, 50, stemmed=stemmed)):
            assert [r["doc_id"] for r in got.collect()] == wanted, (query, stemmed)


def test_evaluation_driver(spark):
    import json

    from foliant.operators import evaluation

    def native(name, content):
        return [content.decode()]

    def scan(name, content):
        if b"boom" in content:
            raise RuntimeError("bad")
        return ["HEAD:", "scanned words"]

    rows = [("lab/a.pdf", "a.pdf", b"%PDF native text that is long enough"), ("lab/b.pdf", "b.pdf", b"%PDF"), ("c_1.png", "c_1.png", b"boom"), ("xray-2.png", "xray-2.png", b"x")]
    df = spark.createDataFrame(rows, "path string, name string, content binary")
    conf = spark.createDataFrame([("lab/b.pdf", 30.0)], "doc_id string, confidence double")
    got = {r["filename"]: r for r in evaluation.evaluate(df, native, scan, conf).collect()}
    assert {k: (r["category"], r["path_taken"], r["failed"]) for k, r in got.items()} == {"lab/a.pdf": ("lab", "native", False), "lab/b.pdf": ("lab", "ocr", False), "c_1.png": ("uncategorized", "error", True), "xray-2.png": ("xray", "ocr", False)}
    assert got["c_1.png"]["error"] == "RuntimeError: bad" and got["c_1.png"]["seconds"] is None and got["lab/a.pdf"]["seconds"] >= 0
    assert "low_confidence" in got["lab/b.pdf"]["flags"] and len(got["c_1.png"]["flags"]) == 1
    stats = evaluation.report(evaluation.evaluate(df, native, scan, conf))
    lines = [json.loads(r["line"]) for r in evaluation.report_json(stats).collect()]
    assert [x["category"] for x in lines] == [None, "lab", "uncategorized", "xray"] and lines[0]["docs"] == 4 and lines[0]["errors"] == 1


def test_headline(spark):
    text = " ".join(["pad"] * 100 + ["hit", "near", "hit"] + ["pad"] * 100)
    s = spark.createDataFrame([(text,), (None,), ("none here",)], "text string").select(search.headline(["hit"])("text").alias("s"))
    a, b, c = (r["s"] for r in s.collect())
    assert a.count("<b>hit</b>") == 2 and 15 <= len(a.split()) <= 35 and b == "" and c == "none here"


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "controll": "control", "probate": "probat", "rate": "rate", "cease": "ceas"}
    assert {w: porter(w) for w in pairs} == pairs


def test_export_files(spark):
    df = spark.createDataFrame([(1, "Clinic (A)", "HEAD:\nbody\\ é漢\na | b\nc | d"), (2, None, None)], "doc_id int, source string, text string")
    rows = parse_structure(df.select("doc_id", "text")).join(df.select("doc_id", "source"), "doc_id")
    pdf = {r["doc_id"]: bytes(r["bytes"]) for r in export.render(rows, "pdf").withColumn("doc_id", F.split("filename", r"\.")[0].cast("int")).collect()}
    assert pdf[1].startswith(b"%PDF") and rb"Clinic \(A\)" in pdf[1] and "é?".encode("latin-1") in pdf[1] and b"no structured data" in pdf[2]
    xref = int(pdf[1].rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert pdf[1][xref : xref + 4] == b"xref"
    for kind, part in (("docx", "word/document.xml"), ("xlsx", "xl/worksheets/sheet2.xml")):
        data = {r["filename"]: bytes(r["bytes"]) for r in export.render(rows, kind).collect()}
        assert ">c<" in zipfile.ZipFile(io.BytesIO(data[f"1.{kind}"])).read(part).decode()
    with pytest.raises(ValueError):
        export.render(rows, "odt")


def test_export_files_of_all_documents(spark, tmp_path):
    from foliant.plans import catalog

    texts = {1: "HEAD:\nbody\na | b\nc | d", 3: "plain", 7: "", 20: "x" * 300, 21: None}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["filename"]: r for r in catalog.QUERIES["export_files"](spark, str(tmp_path)).collect()}
    assert set(got) == {f"{i}.{kind}" for i in texts for kind in export.MIME}
    for kind in export.MIME:
        data = {r["filename"]: bytes(r["bytes"]) for r in export.render(catalog._structured(spark, str(tmp_path)), kind).collect()}
        assert {n: len(b) for n, b in data.items()} == {n: r["n_bytes"] for n, r in got.items() if n.endswith(kind)}
        assert all(b.startswith(b"%PDF") and b.endswith(b"%%EOF\n") if kind == "pdf" else zipfile.ZipFile(io.BytesIO(b)).testzip() is None for b in data.values())


def test_record_projection_of_all_documents(spark, small):
    from foliant.plans import catalog

    assert catalog.QUERIES["record_projection"](spark, small).count() == catalog.documents(spark, small).count()


def test_wrap_and_sizes(spark):
    one = spark.range(1)
    n = lambda k: one.select(F.size(export.wrapped(F.lit("x" * k)))).first()[0]
    assert [n(0), n(100), n(101), n(205)] == [1, 1, 2, 3]
    assert one.select(export.docx_width(F.lit(96)), export.docx_width(F.lit(None).cast("int"))).first()[:] == (1.0, 6.0)


def test_crops_and_deskew(spark):
    r = spark.range(1).select(regions.crop_size(F.lit(3200), F.lit(800), F.lit("logo")).alias("a"), regions.crop_size(F.lit(39), F.lit(80), F.lit("logo")).alias("b"), regions.deskew(F.lit(-88.0), F.lit(100)).alias("c"), regions.deskew(F.lit(20.0), F.lit(100)).alias("d")).first()
    assert tuple(r["a"]) == (1600, 400, "jpg") and r["b"] is None and r["c"] == 2.0 and r["d"] == 0.0


def test_otsu(spark):
    h = spark.createDataFrame([(1, i, 100 if i in (10, 200) else 1) for i in range(256)], "key int, level int, n int")
    assert 10 <= regions.otsu(h).first()["threshold"] < 200


def test_state_keeps_late_key(spark):
    e = spark.createDataFrame([("a", 0, "QUEUED", None), ("a", 1, "PROCESSING", "k"), ("a", 2, "DONE", None)], "doc_id string, seq long, status string, searchable_pdf_key string")
    assert state.current(e).first().asDict() == {"doc_id": "a", "seq": 2, "status": "DONE", "searchable_pdf_key": "k"}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes("HEAD:\nscanned words here".encode())
    (folder / "b.pdf").write_bytes(b"%PDF-1.4 native text that is long enough")
    (folder / "c.png").write_bytes(b"")
    native = lambda name, content: F.array(F.decode(content, "utf-8"))
    recognise = lambda name, content: F.array(F.decode(content, "utf-8"))
    args = (spark, str(folder), str(tmp_path / "log"), str(tmp_path / "structures"), str(tmp_path / "cp"), native, recognise)
    for _ in range(2):  # the second run finds nothing new
        stream.run_stream(*args).awaitTermination()
    now = state.current(stream.read_log(spark, str(tmp_path / "log"))).collect()
    assert sorted((r["raw_file_path"].split("/")[-1], r["status"], r["text_source"]) for r in now) == [("a.txt", "DONE", "ocr"), ("b.pdf", "DONE", "native_pdf")]
    assert spark.read.parquet(str(tmp_path / "structures")).count() == 2


def test_discovery(spark, tmp_path):
    for name in ("a.PDF", "sub/b.tiff", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].split("/")[-1] for r in files.discover(spark, str(tmp_path)).collect()] == ["a.PDF", "b.tiff"]


def test_bad_psm():
    with pytest.raises(ValueError):
        files.check_ocr(14)


def test_blobs(spark, tmp_path):
    from foliant.sources import sinks

    root = str(tmp_path / "store")
    sinks.write_blobs(spark.createDataFrame([("1/a.png", b"x")], sinks.BLOB), root)
    got = sinks.resolved(spark.createDataFrame([("1/a.png",), ("2/b.png",)], "storage_key string"), sinks.read_blobs(spark, root)).collect()
    assert {r["storage_key"]: r["data"] and bytes(r["data"]) for r in got} == {"1/a.png": b"x", "2/b.png": None}
    with pytest.raises(ValueError):
        sinks.write_blobs(spark.createDataFrame([("../a", b"x")], sinks.BLOB), root)


def test_report_paths(spark, tmp_path):
    from foliant.sources import sinks

    assert sinks.check_report_path("/r/reports/../reports/x", "/r") == "/r/reports/x"
    for f, bad in ((sinks.check_report_path, "/r/x"), (sinks.check_report_path, "/r/reports/../x"), (sinks.check_samples_path, "/r/s"), (sinks.check_samples_path, "/r")):
        with pytest.raises(ValueError):
            f(bad, "/r")
    sinks.write_report(spark.createDataFrame([("a",), ("b",)], "line string"), str(tmp_path / "out"), "/r")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]

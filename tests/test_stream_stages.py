"""Crops stored once, structures that fail alone, files recognised once, and grids from word boxes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation, state
from foliant.operators.structure import parse_structure
from foliant.operators.wordgrids import native_tables, word_grids
from foliant.sources import recognisers, sinks
from foliant.streaming import intake as stream

REGION = "regions array<struct<page:int,bbox:array<double>,format:string,data:binary>>, error string"


def reader():
    return recognisers.isolated(lambda name, content: [content.decode()])


def test_crops_in_the_stream(spark, tmp_path):
    """Crops are there by their keys, equal contents are stored once across batches, and a batch that is repeated adds none."""

    @F.pandas_udf(REGION)
    def find(names, contents):
        import pandas as pd

        out = []
        for c in contents:
            if c is None or b"none" in bytes(c):
                out.append((None, None))
            else:
                out.append(([{"page": k, "bbox": [0.0, 1.0], "format": ".jpg" if k else None, "data": x} for k, x in enumerate(bytes(c).split()[:3])], None))
        return pd.DataFrame(out, columns=["regions", "error"], dtype=object)

    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    args = (spark, str(folder), log, str(tmp_path / "structures"), str(tmp_path / "cp"), None, reader())
    (folder / "a.png").write_bytes(b"logo photo logo")
    (folder / "b.png").write_bytes(b"none")
    stream.run_stream(*args, regions=find).awaitTermination()
    (folder / "c.png").write_bytes(b"logo stamp")
    stream.run_stream(*args, regions=find).awaitTermination()
    contents = lambda: sorted(bytes(r["data"]) for r in spark.read.parquet(f"{log}-crops/contents").collect())
    assert contents() == [b"logo", b"photo", b"stamp"]
    names = {r["doc_id"]: r["name"] for r in spark.read.parquet(f"{log}-texts").collect()}
    meta = {names[r["doc_id"]]: r["image_regions"] for r in spark.read.parquet(f"{log}-regions").collect()}
    assert meta["b.png"] is None and [m["storage_key"].split("/", 1)[1] for m in meta["a.png"]] == ["images/0.png", "images/1.jpg", "images/2.jpg"]
    assert meta["c.png"][1]["page"] == 1 and "data" not in meta["a.png"][0].asDict()
    crops = sinks.read_crops(spark, f"{log}-crops")
    keys = spark.createDataFrame([(m["storage_key"],) for ms in meta.values() for m in ms or []], "storage_key string")
    got = {(names[r["storage_key"].split("/")[0]], r["storage_key"].rsplit("/", 1)[1][0]): bytes(r["data"]) for r in sinks.resolved(keys, crops).collect()}
    assert got == {("a.png", "0"): b"logo", ("a.png", "1"): b"photo", ("a.png", "2"): b"logo", ("c.png", "0"): b"logo", ("c.png", "1"): b"stamp"}
    for batch in (0, 1, 1):  # after a failure a batch comes again, also when its contents are elsewhere by then
        texts = spark.read.parquet(f"{log}-texts/batch={batch}")
        sinks.store_crops(stream.region_crops(texts).select("storage_key", "data"), f"{log}-crops", batch)
        assert contents() == [b"logo", b"photo", b"stamp"]
    assert sinks.read_crops(spark, f"{log}-crops").count() == 5


def test_structures_fail_alone(spark, tmp_path):
    """A parser that raises for some documents fails these; the rest of the batch is structured and done."""

    @F.pandas_udf("string")
    def odd(texts):
        def one(t):
            if "odd" in t:
                raise ValueError(f"cannot read {t}")
            return t.upper()

        return texts.map(one)

    def parse(docs):
        return parse_structure(docs.withColumn("text", odd("text")))

    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    for k in range(12):
        (folder / f"{k}.png").write_bytes(f"{'odd' if k in (3, 8) else 'even'} {k}".encode())
    stream.run_stream(spark, str(folder), log, str(tmp_path / "structures"), str(tmp_path / "cp"), None, reader(), parse=parse).awaitTermination()
    now = {r["raw_file_path"].split("/")[-1]: r for r in state.current(stream.read_log(spark, log)).collect()}
    assert {k for k, r in now.items() if r["status"] == "DONE"} == {f"{k}.png" for k in range(12) if k not in (3, 8)}
    for k in (3, 8):
        r = now[f"{k}.png"]
        assert r["status"] == "FAILED" and r["extracted_text"] == f"odd {k}" and r["error_message"] == f"Structure parsing failed: ValueError: cannot read odd {k}"
    assert spark.read.parquet(str(tmp_path / "structures")).count() == 10


def test_files_are_recognised_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def scan(name, content):
        import uuid

        (calls / uuid.uuid4().hex).touch()
        return ["HEAD:", "words of a scan"]

    files = spark.createDataFrame([("lab/a.png", "a.png", b"x"), ("b.png", "b.png", b"y")], "path string, name string, content binary")
    rows = evaluation.evaluate(files, None, scan)
    assert {r["filename"] for r in rows.collect()} == {"lab/a.png", "b.png"} and rows.count() == 2
    assert evaluation.report(rows).where("overall = 1").first()["docs"] == 2
    assert len(list(calls.iterdir())) == 2


def plain_grids(words):
    """The same rules, a page at a time."""
    if any(None in w[:4] or w[0] > w[2] or w[1] >= w[3] for w in words):
        return []
    rows, low = [], None
    for w in sorted((w for w in words if w[4].strip()), key=lambda w: ((w[1] + w[3]) / 2, w[0], w[4])):
        if low is None or w[1] >= low - 0.3 * (w[3] - w[1]):
            rows.append([])
        rows[-1].append(w)
        low = w[3] if low is None else max(low, w[3])
    parts = []
    for r in rows:
        cells, right = [], None
        for w in sorted(r, key=lambda w: (w[0], w[2], w[4])):
            if right is None or w[0] - right > w[3] - w[1]:
                cells.append([])
            cells[-1].append(w)
            right = w[2] if right is None else max(right, w[2])
        parts.append(([(min(w[0] for w in c), max(w[2] for w in c), " ".join(w[4] for w in c)) for c in cells], min(w[1] for w in r), max(w[3] for w in r)))
    tables, before = [], None
    for cells, top, bottom in parts:
        if len(cells) >= 2:
            if before is None or before[0] < 2 or top - before[1] > 2.5 * (bottom - top):
                tables.append([])
            tables[-1].append(cells)
        before = (len(cells), bottom)
    out = []
    for t in tables:
        spans, right = [], None
        for a, b, k, i in sorted((c[0], c[1], k, i) for k, row in enumerate(t) for i, c in enumerate(row)):
            if right is None or a > right:
                spans.append([])
            spans[-1].append((k, i))
            right = b if right is None else max(right, b)
        if len(t) >= 2 and len(spans) >= 2:
            out.append([[" ".join(t[k][i][2] for k, i in sorted(s) if k == n) or None for s in spans] for n in range(len(t))])
    return out


def test_word_grids(spark):
    r, pages = random.Random(11), {}
    for p in range(60):
        words, y = [], 0.0
        for _ in range(r.randint(1, 14)):
            y += r.choice([12, 12, 12, 14, 60])
            if r.random() < 0.2:
                words += [(k * 22.0, y, k * 22 + 20.0, y + 10, f"t{k}") for k in range(5)]  # a line of text
            else:
                for c in range(r.choice([2, 3, 3, 4])):
                    if r.random() < 0.85:
                        x = c * 100 + r.randint(0, 12)
                        words += [(float(x + 24 * k), y + r.choice([0, 1, 2]), float(x + 24 * k + 20), y + 10, r.choice(["a", "bb", " ", "c d"])) for k in range(r.choice([1, 1, 2, 6]))]
        if p % 13 == 5 and words:
            words[0] = r.choice([(None, 1.0, 2.0, 3.0, "x"), (9.0, 1.0, 2.0, 3.0, "x"), (1.0, 5.0, 2.0, 5.0, "x")])
        pages[p] = words
    rows = [(p % 7, p, *w) for p, ws in pages.items() for w in ws]
    words = spark.createDataFrame(rows, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string").repartition(4)
    got = {}
    for x in sorted(word_grids(words).collect(), key=lambda x: x["table_no"]):
        got.setdefault(x["page"], []).append(x["rows"])
    expected = {p: g for p, ws in pages.items() if (g := plain_grids([(*w[:4], w[4]) for w in ws]))}
    assert got == expected and len(expected) > 30 and not any(p % 13 == 5 for p in expected if pages[p])
    tables = {x["doc_id"]: x["native_tables"] for x in native_tables(words).collect()}
    assert tables == {d: t for d in range(7) if (t := [g for p in sorted(expected) if p % 7 == d for g in expected[p]])}

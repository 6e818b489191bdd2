"""State by document, compaction, keyed lookups, ranges of pages, requests in flight, PDFs in parts."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import state
from foliant.sources import recognisers, sinks
from foliant.streaming.current import compact_log, current_rows, keep_current

EVENT = "doc_id string, seq long, status string, searchable_pdf_key string"


def events(n, seed):
    r = random.Random(seed)
    out = [(f"d{r.randint(0, 40)}", i, r.choice(state.STATUSES), f"k{i}" if r.random() < 0.2 else None) for i in range(n)]
    r.shuffle(out)
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "seq", "status", "searchable_pdf_key").collect()))


def test_current_by_state(spark, tmp_path):
    """Batches in no order, some events twice, equal the aggregate over the whole log."""
    log, done = events(300, 1), []
    for part in (log[:120], log[100:250], log[250:], log[:30]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done += part
        keep_current(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "rows"), str(tmp_path / "check")).awaitTermination()
        assert rows_of(current_rows(spark, str(tmp_path / "rows"))) == rows_of(state.current(spark.createDataFrame(done, EVENT)))
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass") or "")


def test_compacted_log(spark, tmp_path):
    log, root = events(400, 2), str(tmp_path / "log")
    spark.createDataFrame([(*e, k % 6) for k, e in enumerate(log)], EVENT + ", batch int").write.partitionBy("batch").parquet(root)
    whole = rows_of(state.current(spark.createDataFrame(log, EVENT)))
    read = lambda: spark.read.option("mergeSchema", "true").parquet(root)
    for upto in (0, 2, 2, 4):
        compact_log(spark, root, upto)
        assert rows_of(state.current(read().drop("batch"))) == whole
    assert read().count() < len(log) and {p.name for p in (tmp_path / "log").glob("batch=*")} == {"batch=upto-4", "batch=5"}
    # one that stopped before the old parts went
    spark.createDataFrame([e for k, e in enumerate(log) if k % 6 == 1], EVENT).write.parquet(f"{root}/batch=1")
    assert rows_of(state.current(read().drop("batch"))) == whole
    compact_log(spark, root, 4)
    assert rows_of(state.current(read().drop("batch"))) == whole and not (tmp_path / "log" / "batch=1").exists()


def test_keyed_lookup(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(7, "again"), (None, "none")], "doc_id long, text string")
    path = str(tmp_path / "keyed")
    table = sinks.write_keyed(rows, "doc_id", path, 8)
    for t in (table, sinks.open_keyed(spark, rows.schema, "doc_id", path, 8)):
        found = sinks.lookup(t, "doc_id", 7)
        assert sorted(r["text"] for r in found.collect()) == ["again", "text 7"]
        assert "EqualTo(doc_id,7)" in found._jdf.queryExecution().executedPlan().toString()
        assert sinks.lookup(t, "doc_id", -1).count() == sinks.lookup(t, "doc_id", None).count() == 0
    # without the other buckets' files a lookup gives the same, and a scan of all fails
    (file,) = {r[0].rsplit("/", 1)[1] for r in found.select(F.input_file_name()).collect()}
    others = [p for p in (tmp_path / "keyed").glob("*.parquet") if p.name != file]
    assert len(others) == 7
    for p in others:
        p.unlink()
    assert sorted(r["text"] for r in found.collect()) == ["again", "text 7"]
    with pytest.raises(Exception, match="does not exist"):
        t.where("text = 'text 8'").collect()


def test_page_ranges(spark):
    """One file of many pages fills all tasks; pages keep their numbers; errors stay with their page."""

    def count(name, content):
        if content == b"bad":
            raise ValueError("broken")
        return int(content)

    def some(name, content, first, end):
        import os

        for i in range(first, end):
            if name == "fails" and i == 13:
                raise RuntimeError("page 13")
            if name == "short" and i == 3:
                return
            yield f"{name}-{i}-{os.getpid()}".encode()

    files = spark.createDataFrame([(1, "big", b"100"), (2, "x", b"bad"), (3, "fails", b"20"), (4, "none", b"0"), (5, "short", b"5")], "doc_id int, name string, content binary").coalesce(1)
    items = recognisers.page_ranges(files, count, 8)
    made = recognisers.ranged_pages(items, some, 4)
    got = made.withColumn("task", F.spark_partition_id()).collect()
    big = sorted((r["page"], bytes(r["image"]).split(b"-")[1]) for r in got if r["doc_id"] == 1)
    assert big == [(i, str(i).encode()) for i in range(100)]
    assert {r["task"] for r in got if r["doc_id"] == 1} == {0, 1, 2, 3}
    errors = {(r["doc_id"], r["page"]): r["error"] for r in got if r["error"]}
    assert errors == {(2, 0): "ValueError: broken", (3, 13): "RuntimeError: page 13", (4, 0): "no pages", (5, 3): "pages are missing"}
    assert sorted(r["page"] for r in got if r["doc_id"] == 3) == [*range(14), *range(16, 20)]
    texts = recognisers.page_texts(recognisers.recognised_pages(made, lambda image, lang, psm: image.decode().split("-")[1]))
    assert {r["doc_id"]: (r["text"], r["error"]) for r in texts.collect()}[1] == ("\n\n".join(map(str, range(100))), None)


def test_requests_in_flight(spark, tmp_path):
    """A server that counts: never more at once than allowed, several at once, answers in order, failures in their rows."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    now, most, lock = 0, 0, threading.Lock()

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            nonlocal now, most
            with lock:
                now += 1
                most = max(most, now)
            body = self.rfile.read(int(self.headers["Content-Length"]))
            name = body.split(b'filename="')[1].split(b'"')[0].decode()
            time.sleep(3 if name == "f9" else 0.05 * (1 + int(name[1:]) % 3))
            with lock:
                now -= 1
            self.send_response(500 if name == "f5" else 200)
            self.end_headers()
            if name != "f7":
                self.wfile.write(name.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = recognisers.http_sender(f"http://127.0.0.1:{server.server_port}/", 1.0)
    files = spark.createDataFrame([(i, f"f{i}", None if i == 3 else b"x") for i in range(24)], "doc_id int, name string, content binary").coalesce(1)
    got = recognisers.posted(files, send, {"lang": "eng"}, at_once=4, empty_is_error=True).collect()
    server.shutdown()
    assert [r["doc_id"] for r in got] == list(range(24)) and 1 < most <= 5  # the one that timed out may still be there
    by = {r["doc_id"]: r for r in got}
    assert (by[5]["kind"], by[5]["error"]) == ("error", "status 500") and by[7]["error"] == "empty body" and by[9]["kind"] == "timeout"
    assert tuple(by[3]) == (3, None, None, None)
    assert all(bytes(r["body"]) == f"f{i}".encode() for i, r in by.items() if i not in (3, 5, 7, 9))


def test_pdf_parts(spark, tmp_path):
    """The parts of a PDF of 500 pages, one page a row, are the PDF that is made at once; a bad page and a document without any are errors."""
    image = lambda h, w, seed: (("", h, w, 3, 16, bytes((x * seed) % 256 for x in range(h * w * 3))),)
    schema = "doc_id int, page int, text string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = [(1, p, f"page (no) {p}\nmore", *image(8, 6, p + 1)) for p in range(500)]
    rows += [(2, 3, None, *image(4, 4, 1)), (2, 8, "x", *image(2, 5, 3)), (3, 0, "bad", ("", 9, 9, 3, 16, b"short"))]
    pages = spark.createDataFrame(rows, schema).repartition(8)
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int")
    recognisers.write_parts(recognisers.searchable_pdf_parts(docs, pages), str(tmp_path / "parts"), 4)
    whole = {r["doc_id"]: r["data"] for r in recognisers.searchable_pdfs(docs, pages.where("doc_id < 3")).collect()}
    for i in (1, 2):
        parts = list(recognisers.read_file(spark, str(tmp_path / "parts"), i))
        assert b"".join(parts) == bytes(whole[i]) and len(parts) == {1: 502, 2: 4}[i]
    assert max(len(p) for p in recognisers.read_file(spark, str(tmp_path / "parts"), 1)) < 40_000
    data = b"".join(recognisers.read_file(spark, str(tmp_path / "parts"), 1))
    start = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    table = data[start:].split(b"\n")
    assert table[0] == b"xref" and all(data[int(x.split()[0]) :].startswith(b"%d 0 obj" % n) for n, x in enumerate(table[3 : 3 + 1503], 1))
    for i, text in ((3, "ValueError"), (4, "no pages")):
        with pytest.raises(ValueError, match=text):
            list(recognisers.read_file(spark, str(tmp_path / "parts"), i))

"""Calls of recognisers and services, pages, searchable PDFs, pictures in exports, and the stages of the stream."""

import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import export, pixels, regions, state
from foliant.sources import files, recognisers
from foliant.streaming import intake as stream


def reader():
    """A recogniser; made here so that workers get it by value."""

    def read(name, content):
        if b"boom" in content:
            raise RuntimeError("bad scan")
        if b"slow" in content:
            raise TimeoutError("too long")
        return [content.decode()]

    return read


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, name string, content binary")


def test_extract_isolates_errors(spark):
    """One bad file is a row with an error; native text is asked of PDFs only, recognition of what has none."""
    rows = [("a", "a.pdf", b"%PDF native text that is long enough"), ("b", "b.pdf", b"%PDF boom, so it is scanned"), ("c", "c.png", b"scanned words"), ("d", "d.png", b"boom"), ("e", "e.png", b""), ("f", "f.PDF", b"short"), ("g", "g.png", None)]

    read = reader()

    def native(name, content):
        assert name.lower().endswith("pdf")
        return read(name, content)

    def scan(name, content):
        assert name != "a.pdf"
        return ["scan", name] if b"PDF" in content else read(name, content)

    got = {r["doc_id"]: (r["text"], r["text_source"], r["error"]) for r in files.extract(frame(spark, rows), recognisers.isolated(native), recognisers.isolated(scan)).collect()}
    assert got == {
        "a": ("%PDF native text that is long enough", "native_pdf", None), "b": ("scan\n\nb.pdf", "ocr", None), "c": ("scanned words", "ocr", None), "d": (None, None, "RuntimeError: bad scan"),
        "e": (None, None, "empty file"), "f": ("short", "ocr", None), "g": (None, None, "empty file"),
    }


def test_pages_of_scans(spark):
    """A row a page, texts in order with blank ones kept; an error of one page is the document's."""
    def rasterise(name, content):
        for part in content.split(b"|"):
            if part == b"torn":
                raise ValueError("torn")
            yield part

    def call(image, lang, psm):
        assert (lang, psm) == (None, 4)
        if image == b"bad":
            raise RuntimeError("unreadable")
        return image.decode()

    rows = [("a", "a.pdf", b"one||three" + b"|x" * 12), ("b", "b.pdf", b"one|bad|three"), ("c", "c.pdf", b"one|torn")]
    pages = recognisers.recognised_pages(recognisers.page_rows(frame(spark, rows), rasterise).repartition(5), call, "", 4)
    got = {r["doc_id"]: (r["text"], r["error"]) for r in recognisers.page_texts(pages).collect()}
    assert got == {"a": ("one\n\n\n\nthree" + "\n\nx" * 12, None), "b": (None, "RuntimeError: unreadable"), "c": (None, "ValueError: torn")}
    none = recognisers.page_rows(frame(spark, [("d", "d.pdf", b"")]), lambda name, content: iter(())).first()
    assert (none["error"], none["image"]) == ("no pages", None)


def test_service(spark):
    """Forms leave empty fields out; statuses, empty bodies and timeouts are told apart; payloads get defaults."""
    body, kind = recognisers.multipart('a"b.pdf', b"DATA", {"lang": "", "psm": "6", "none": None})
    assert b"lang" not in body and b'name="psm"\r\n\r\n6' in body and b'filename="a\\"b.pdf"' in body and b"\r\n\r\nDATA\r\n--" in body and kind.split("=")[1].encode() in body

    def send(body, kind):
        for word, result in ((b"missing", (404, b"no")), (b"nothing", (200, b""))):
            if word in body:
                return result
        if b"slow" in body:
            raise TimeoutError("late")
        if b"gone" in body:
            raise OSError("refused")
        return 200, json.dumps({"text": "t", "images": [{"bbox": [0, 0, 1, 1], "image_base64": "eA=="}, {"image_base64": "!"}]}).encode()

    rows = [(w, w + ".pdf", w.encode()) for w in ("fine", "missing", "nothing", "slow", "gone")] + [("null", "x", None)]
    df = frame(spark, rows).withColumn("r", recognisers.service(send, {"lang": "eng"}, True)("name", "content"))
    got = {r["doc_id"]: (r["r"]["kind"], r["r"]["error"]) for r in df.collect()}
    assert got == {"fine": (None, None), "missing": ("error", "status 404"), "nothing": ("error", "empty body"), "slow": ("timeout", "TimeoutError: late"), "gone": ("error", "OSError: refused"), "null": (None, None)}
    p = df.where("doc_id = 'fine'").select(files.payload(recognisers.answer(F.col("r.body"))).alias("p")).first()["p"]
    assert (p["text"], p["text_source"], p["tables"], len(p["images"])) == ("t", "ocr", [], 1)


def image(value, h=60, w=80):
    page = np.full((h, w, 3), value, np.uint8)
    page[10:20, 10:50] = 0
    return ("f", h, w, 3, 16, page.tobytes())


PAGE = "doc_id string, page int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, text string"


def test_searchable_pdfs(spark):
    """Pages in order with their image and text; no pages, or one that can't be read, is an error."""
    pages = spark.createDataFrame([("a", k, image(200 + k), f"word{k} (x)\nline") for k in (2, 0, 1)] + [("b", 0, ("f", 5, 5, 3, 16, b"short"), "t")], PAGE)
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    got = {r["doc_id"]: r for r in recognisers.searchable_pdfs(docs, pages).collect()}
    data = bytes(got["a"]["data"])
    assert data.startswith(b"%PDF") and b"/Count 3" in data and [data.find(b"(word%d \\(x\\)) Tj" % k) for k in range(3)] == sorted(data.find(b"(word%d \\(x\\)) Tj" % k) for k in range(3)) and b"3 Tr" in data
    start = data.index(b"stream\n", data.index(b"/FlateDecode")) + 7
    assert zlib.decompressobj().decompress(data[start:]) == np.frombuffer(image(200)[5], np.uint8).reshape(60, 80, 3)[:, :, ::-1].tobytes()
    xref = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    offsets = [int(x[:10]) for x in data[xref:].split(b"\n")[3:15]]
    assert all(data[o:].startswith(b"%d 0 obj" % (k + 1)) for k, o in enumerate(offsets))
    assert "ValueError" in got["b"]["error"] and got["c"]["error"] == "ValueError: no pages" and got["c"]["data"] is None


def test_region_texts(spark):
    seen = []

    def call(part, lang, psm):
        assert (lang, psm) == ("eng", 6)
        if part.shape[0] == 7:
            raise RuntimeError("no")
        return f"{part.shape[0]}x{part.shape[1]}"

    boxes = spark.createDataFrame([("a", 0, 1, 10, 10, 40, 10), ("a", 0, 2, 0, 0, 9, 7), ("a", 1, 1, 70, 50, 30, 30), ("z", 0, 1, 0, 0, 5, 5)], "doc_id string, page int, ord int, x int, y int, w int, h int")
    pages = spark.createDataFrame([("a", k, image(200), None) for k in (0, 1)], PAGE)
    got = {(r["doc_id"], r["page"], r["ord"]): r["text"] for r in recognisers.region_texts(pages, boxes, call).collect()}
    assert got == {("a", 0, 1): "10x40", ("a", 0, 2): None, ("a", 1, 1): "10x10", ("z", 0, 1): None} and not seen


def test_pictures_in_exports(spark):
    """DOCX and XLSX hold the pictures at their sizes; data that is missing or no picture leaves a note."""
    wide = pixels.png(np.zeros((100, 1200, 3), np.uint8))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x20\x00\x40\x01\x01\x11\x00\xff\xd9"
    assert export.picture_kind(wide) == ("png", 1200, 100) and export.picture_kind(jpeg) == ("jpeg", 64, 32)
    figures = [("Figure 1", 1200, 100, "png", None, wide), ("Figure 2", None, None, "jpg", None, jpeg), ("Figure 3", 10, 10, "jp2", [1.0], b"JP2"), ("Figure 4", 10, 10, "png", None, None)]
    kind = "array<struct<caption:string,width:int,height:int,format:string,bbox:array<double>,data:binary>>"
    from foliant.operators.structure import parse_structure

    docs = spark.createDataFrame([(1, "s", "t", figures), (2, "s", "t", [])], f"doc_id int, source string, text string, figures {kind}")
    rows = parse_structure(docs.select("doc_id", "text")).join(docs.drop("text"), "doc_id")
    for form, folder, part in (("docx", "word", "word/document.xml"), ("xlsx", "xl", "xl/drawings/drawing1.xml")):
        made = {r["doc_id"]: zipfile.ZipFile(io.BytesIO(bytes(r["bytes"]))) for r in export.render(rows, form).withColumn("doc_id", F.split("filename", r"\.")[0].cast("int")).collect()}
        z = made[1]
        assert z.read(f"{folder}/media/figure1.png") == wide and z.read(f"{folder}/media/figure2.jpeg") == jpeg and len([n for n in z.namelist() if "media" in n]) == 2
        text = z.read(part).decode()
        width = 6 * 914400 if form == "docx" else 600 * 9525
        assert f'cx="{width}"' in text and f'cy="{width // 12}"' in text and 'r:embed="p2"' in text
        notes = z.read(part if form == "docx" else "xl/worksheets/sheet2.xml").decode()
        assert ("[Figure 3: could not embed image (neither PNG nor JPEG)]" in notes and "[Figure 4: image data unavailable]" in notes) if form == "docx" else ("[image could not be embedded]" in notes and "[image data unavailable]" in notes and "[picture]" not in notes)
        assert not [n for n in made[2].namelist() if "media" in n]
        import xml.dom.minidom

        for n in z.namelist():
            if n.endswith((".xml", ".rels")):
                xml.dom.minidom.parseString(z.read(n))
    again = export.docx_bytes([{"kind": "picture", "text": "1.0"}], [{"n": 1, "data": b"JP2"}], lambda data: wide)
    assert zipfile.ZipFile(io.BytesIO(again)).read("word/media/figure1.png") == wide


def test_stream_stages(spark, tmp_path):
    """Timeouts and other failures are routed and end there; regions and searchable PDFs that fail change nothing; a structure that fails keeps the text."""
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"ok.png": b"HEAD:\nwords", "slow.png": b"slow", "boom.png": b"boom", "odd.png": b"odd words", "native.pdf": b"%PDF native text that is long enough"}
    for name, content in texts.items():
        (folder / name).write_bytes(content)

    @F.pandas_udf("regions array<string>, error string")
    def find(names, contents):
        import pandas as pd

        return pd.DataFrame([(None, "ValueError: no pixels") if c is None or b"odd" in bytes(c) else (["r"], None) for c in contents], columns=["regions", "error"], dtype=object)

    def make(docs):
        return docs.select("doc_id", F.when(F.col("name") != "odd.png", F.lit(b"%PDF")).alias("data"), F.when(F.col("name") == "odd.png", "no pages").alias("error"))

    check = lambda text: F.when(text.contains("odd"), "bad structure")
    log = str(tmp_path / "log")
    args = (spark, str(folder), log, str(tmp_path / "structures"), str(tmp_path / "cp"), recognisers.isolated(reader()), recognisers.isolated(reader()))
    stream.run_stream(*args, regions=find, check=check, make=make, lang="eng", seconds=240.0).awaitTermination()
    events = stream.read_log(spark, log)
    now = {r["raw_file_path"].split("/")[-1]: r for r in state.current(events).collect()}
    assert {k: (r["status"], r["error_message"]) for k, r in now.items()} == {
        "ok.png": ("DONE", None), "native.pdf": ("DONE", None), "slow.png": ("FAILED", "OCR service timed out after 240s"),
        "boom.png": ("FAILED", "OCR extraction failed: RuntimeError: bad scan"), "odd.png": ("FAILED", "Structure parsing failed: bad structure"),
    }
    assert now["odd.png"]["extracted_text"] == "odd words" and now["ok.png"]["ocr_lang"] == "eng" and now["slow.png"]["extracted_text"] is None
    keys = {k: r["searchable_pdf_key"] for k, r in now.items()}
    assert keys["ok.png"].endswith("/searchable.pdf") and not any(keys[k] for k in keys if k != "ok.png")
    assert spark.read.parquet(str(tmp_path / "structures")).count() == 2
    found = {r["name"]: (r["regions"], r["region_error"]) for r in spark.read.parquet(f"{log}-texts").collect()}
    assert found["ok.png"] == (["r"], None) and found["odd.png"] == (None, "ValueError: no pixels") and spark.read.parquet(f"{log}-texts").where("name = 'odd.png' and text is not null").count() == 1
    steps = [r["status"] for r in events.where("raw_file_path like '%ok.png'").orderBy("seq").collect()]
    assert steps == ["QUEUED", "PROCESSING", "PROCESSING", "DONE", "DONE"]


def test_parameters(spark):
    assert files.check_ocr() == {"psm": 6, "extract_images": True}
    for bad in ({"psm": 14}, {"psm": -1}, {"psm": True}, {"extract_images": "yes"}):
        with pytest.raises(ValueError):
            files.check_ocr(**bad)
    got = spark.range(1).select(files.lang_outcome(F.lit("eng"), None), files.lang_outcome(F.lit("eng+guj"), None)).first()
    assert tuple(got) == ("ok", "400:guj")
    box = spark.range(1).select(regions.render_box(F.array(*map(F.lit, (-5.0, 10.0, 72.0, 46.0))), F.lit(612.0), F.lit(792.0)).alias("a"), regions.render_box(F.array(*map(F.lit, (700.0, 10.0, 800.0, 46.0))), F.lit(612.0), F.lit(792.0)).alias("b")).first()
    assert tuple(box["a"]) == (0.0, 10.0, 72.0, 46.0, 200, 100) and box["b"] is None

"""Recognisers at the boundary: isolated calls, pages of scans, table regions, HTTP services, searchable PDFs.

A recogniser is a plain Python function that the caller gives. What it raises becomes a value of the row it was called
for, never a failure of the task.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.pixels import unpacked
from foliant.sources.files import scanned_text
from foliant.sources.shared import shared_folder

#: What table regions are read with, whatever was asked for (fixed values).
REGION_LANG, REGION_PSM = "eng", 6


def message(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


def isolated(call: Callable[[str, bytes], list[str]]) -> Callable[[Column, Column], Column]:
    """A column function of (name, content) that gives struct<pages,error>: what call returns, or what it raised; null content gives null."""

    @F.pandas_udf("pages array<string>, error string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, content in zip(names, contents, strict=True):
            try:
                out.append((None if content is None else list(call(name, bytes(content))), None))
            except Exception as e:
                out.append((None, message(e)))
        return pd.DataFrame(out, columns=["pages", "error"], dtype=object)

    return run


PAGES = "doc_id {}, page int, image binary, error string"


def page_rows(files: DataFrame, rasterise: Callable[[str, bytes], Iterator[bytes]]) -> DataFrame:
    """A row (doc_id, page, image, error) for each page of files (doc_id, name, content), pages from 0 as they are rasterised.

    A file that can't be rasterised, in whole or from some page on, has a row with an error there; one without pages has such
    a row too.
    """
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, name, content = (c[i].as_py() for c in batch.columns)
                page = 0
                try:
                    for image in rasterise(name, content):
                        yield of(batch, doc, page, image, None)
                        page += 1
                    if not page:
                        yield of(batch, doc, 0, None, "no pages")
                except Exception as e:
                    yield of(batch, doc, page, None, message(e))

    def of(batch, doc, page, image, error):
        return pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([page], pa.int32()), pa.array([image], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "page", "image", "error"])

    return files.select("doc_id", "name", "content").mapInArrow(run, PAGES.format(kind))


def page_ranges(files: DataFrame, count: Callable[[str, bytes], int], each: int = 8) -> DataFrame:
    """A row (doc_id, name, content, first, end, error) for each `each` pages of files (doc_id, name, content): items of like work.

    count(name, content) tells the pages without making them. A file for which it fails, or that has none, has one row with the
    error. A file of many pages becomes many rows, each with the file's bytes, which intake bounds.
    """

    @F.pandas_udf("n int, error string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, content in zip(names, contents, strict=True):
            try:
                n = count(name, bytes(content))
                out.append((n, None if n > 0 else "no pages"))
            except Exception as e:
                out.append((0, message(e)))
        return pd.DataFrame(out, columns=["n", "error"])

    counted = files.select("doc_id", "name", "content").withColumn("r", run("name", "content"))
    starts = F.when(F.col("r.n") > 0, F.sequence(F.lit(0), F.col("r.n") - 1, F.lit(each))).otherwise(F.array(F.lit(0)))
    rows = counted.select("doc_id", "name", "content", F.explode(starts).alias("first"), F.col("r.n").alias("n"), F.col("r.error").alias("error"))
    return rows.select("doc_id", "name", "content", "first", F.least("n", F.col("first") + each).alias("end"), "error")


def ranged_pages(items: DataFrame, rasterise: Callable[[str, bytes, int, int], Iterator[bytes]], tasks: int) -> DataFrame:
    """What page_rows() gives, of page_ranges() dealt evenly to so many tasks; rasterise(name, content, first, end) makes some pages.

    A range that fails has an error at the page where it did, and the document's other ranges keep theirs; so has one that ends
    before its last page.
    """
    kind = items.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, name, content, first, end, error = (c[i].as_py() for c in batch.columns)
                page = first
                of = lambda image, error: pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([page], pa.int32()), pa.array([image], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "page", "image", "error"])  # noqa: B023, E731
                try:
                    for image in rasterise(name, content, first, end) if error is None else ():
                        yield of(image, None)
                        page += 1
                    if error is not None or page < end:
                        yield of(None, error or "pages are missing")
                except Exception as e:
                    yield of(None, message(e))

    return items.select("doc_id", "name", "content", "first", "end", "error").repartition(tasks).mapInArrow(run, PAGES.format(kind))


def recognised_pages(pages: DataFrame, call: Callable[[bytes, str | None, int], str], lang: str | None = None, psm: int = 6) -> DataFrame:
    """pages (doc_id, page, image, error) with text; call(image, lang, psm) is made for each page by itself, an empty lang is none."""

    @F.pandas_udf("text string, error string")
    def run(images: pd.Series) -> pd.DataFrame:
        out = []
        for image in images:
            try:
                out.append((None if image is None else call(bytes(image), lang or None, psm), None))
            except Exception as e:
                out.append((None, message(e)))
        return pd.DataFrame(out, columns=["text", "error"], dtype=object)

    return pages.withColumn("_r", run("image")).select("doc_id", "page", "image", F.col("_r.text").alias("text"), F.coalesce("error", "_r.error").alias("error"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text, error) of recognised pages: texts in the order of pages, blank ones too; the first page's error makes the text null."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text", "error"))).alias("p")
    rows = pages.groupBy("doc_id").agg(ordered).withColumn("error", F.get(F.filter("p", lambda x: x["error"].isNotNull()), F.lit(0))["error"])
    return rows.select("doc_id", F.when(F.col("error").isNull(), scanned_text(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))))).alias("text"), "error")


def region_texts(pages: DataFrame, regions: DataFrame, call: Callable) -> DataFrame:
    """regions (doc_id, page, ord, x, y, w, h, …) with text, that call(image as an array, lang, psm) reads in each of them, always in REGION_LANG and REGION_PSM; null where it fails.

    pages: (doc_id, page, image) as Spark's image source gives them.
    """

    @F.pandas_udf("array<string>")
    def run(images: pd.DataFrame, boxes: pd.Series) -> pd.Series:
        out = []
        for image, wanted in zip(images.itertuples(index=False), boxes, strict=True):
            texts = []
            for b in wanted:
                try:
                    page = unpacked(image.height, image.width, image.nChannels, image.data)
                    texts.append(call(page[max(0, b["y"]) : b["y"] + b["h"], max(0, b["x"]) : b["x"] + b["w"]], REGION_LANG, REGION_PSM))
                except Exception:
                    texts.append(None)
            out.append(texts)
        return pd.Series(out, dtype=object)

    keys = ["doc_id", "page"]
    wanted = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("b"))
    image = F.struct("image.height", "image.width", "image.nChannels", "image.data")
    read = pages.join(wanted, keys).withColumn("t", run(image, F.col("b"))).select(*keys, F.explode(F.arrays_zip("b", "t")).alias("x"))
    return regions.join(read.select(*keys, F.col("x.b.ord").alias("ord"), F.col("x.t").alias("text")), [*keys, "ord"], "left")


def multipart(name: str, content: bytes, fields: dict[str, str | None]) -> tuple[bytes, str]:
    """The body and the content type of a form with one file; fields that are empty are left out."""
    mark = uuid.uuid5(uuid.NAMESPACE_OID, f"{name}|{zlib.crc32(content)}").hex
    quoted = name.replace("\\", "\\\\").replace('"', '\\"').replace("\r", " ").replace("\n", " ")
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items() if v]
    head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{quoted}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode()
    return b"".join(parts) + head + content + f"\r\n--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def http_sender(url: str, seconds: float) -> Callable[[bytes, str], tuple[int, bytes]]:
    """send(body, content type) by POST: status and body; a timeout raises TimeoutError."""

    def send(body: bytes, kind: str) -> tuple[int, bytes]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": kind}), timeout=seconds) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError(str(e.reason)) from e
            raise

    return send


ANSWER = "body binary, kind string, error string"


def service(send: Callable[[bytes, str], tuple[int, bytes]], fields: dict[str, str | None] | None = None, empty_is_error: bool = False) -> Callable[[Column, Column], Column]:
    """A column function of (name, content) that posts the file: struct<body,kind,error>.

    kind is `timeout` or `error`, null for an answer. A status other than 200 is an error, and an empty body where it is asked
    to be, as of a service that makes searchable PDFs. files.payload() reads the JSON of one that extracts.
    """

    @F.pandas_udf(ANSWER)
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, content in zip(names, contents, strict=True):
            try:
                status, body = (200, None) if content is None else send(*multipart(name or "upload", bytes(content), fields or {}))
                if status != 200:
                    out.append((None, "error", f"status {status}"))
                elif content is not None and empty_is_error and not body:
                    out.append((None, "error", "empty body"))
                else:
                    out.append((body, None, None))
            except TimeoutError as e:
                out.append((None, "timeout", message(e)))
            except Exception as e:
                out.append((None, "error", message(e)))
        return pd.DataFrame(out, columns=["body", "kind", "error"], dtype=object)

    return run


def posted(files: DataFrame, send: Callable[[bytes, str], tuple[int, bytes]], fields: dict[str, str | None] | None = None, *, at_once: int = 4, empty_is_error: bool = False) -> DataFrame:
    """files (doc_id, name, content) to (doc_id, body, kind, error), as service() gives them, with several requests in flight.

    A task has at most at_once requests open and takes no further file before the oldest is answered, so it never holds more
    than their answers; these come in the files' order. send bounds each request's time. A null content is not sent.
    """

    def one(name, content):
        try:
            status, body = send(*multipart(name or "upload", content, fields or {}))
            if status != 200:
                return None, "error", f"status {status}"
            return (None, "error", "empty body") if empty_is_error and not body else (body, None, None)
        except TimeoutError as e:
            return None, "timeout", message(e)
        except Exception as e:
            return None, "error", message(e)

    def run(batches):
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        def answered(open_):
            doc, future = open_.popleft()
            body, kind, error = (None, None, None) if future is None else future.result()
            return pa.RecordBatch.from_arrays([doc, pa.array([body], pa.binary()), pa.array([kind], pa.string()), pa.array([error], pa.string())], names=["doc_id", "body", "kind", "error"])

        with ThreadPoolExecutor(at_once) as pool:
            open_: deque = deque()
            for batch in batches:
                for i in range(batch.num_rows):
                    if len(open_) == at_once:
                        yield answered(open_)
                    name, content = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    open_.append((batch.column(0).slice(i, 1), None if content is None else pool.submit(one, name, content)))
            while open_:
                yield answered(open_)

    return files.select("doc_id", "name", "content").mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {ANSWER}")


def _object(number: int, body: bytes) -> bytes:
    return b"%d 0 obj\n" % number + body + b"\nendobj\n"


def pdf_head(pages: int) -> tuple[bytes, list[int]]:
    """The first part of a PDF of so many pages, and where its objects 1 to 3 start."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {pages} /Kids [{' '.join(f'{4 + 3 * i} 0 R' for i in range(pages))}] >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out, starts = b"%PDF-1.4\n", []
    for n, body in enumerate(bodies, 1):
        starts.append(len(out))
        out += _object(n, body)
    return out, starts


def pdf_page(i: int, width: int, height: int, rgb: bytes, text: str | None, dpi: int = 200) -> tuple[bytes, list[int]]:
    """Page i's own objects 4 + 3 i to 6 + 3 i, which need nothing of other pages, and where they start in them: the image, and over it the text's lines, invisible but found by a search."""

    def stream(head: str, data: bytes) -> bytes:
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"

    w, h, lines = width * 72 / dpi, height * 72 / dpi, (text or "").split("\n")
    size = max(1.0, min(12.0, h / max(1, len(lines))))
    shown = "\n".join("(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj T*" for x in lines)
    content = f"q {w:.2f} 0 0 {h:.2f} 0 0 cm /Im Do Q\nBT 3 Tr /F1 {size:.2f} Tf {size:.2f} TL 0 {h - size:.2f} Td\n{shown}\nET".encode("latin-1", "replace")
    bodies = [
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.2f} {h:.2f}] /Resources << /Font << /F1 3 0 R >> /XObject << /Im {6 + 3 * i} 0 R >> >> /Contents {5 + 3 * i} 0 R >>".encode(),
        stream("", content), stream(f"/Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(rgb)),
    ]
    parts = [_object(4 + 3 * i + k, body) for k, body in enumerate(bodies)]
    return b"".join(parts), [0, len(parts[0]), len(parts[0]) + len(parts[1])]


def pdf_tail(starts: list[int], size: int) -> bytes:
    """The last part, after size bytes: where each object starts."""
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(starts) + 1) + b"".join(b"%010d 00000 n \n" % x for x in starts)
    return table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(starts) + 1, size)


def pdf_of_scans(pages: list[tuple[int, int, bytes, str]], dpi: int = 200) -> bytes:
    """A PDF of pages (width, height, RGB bytes, text)."""
    if not pages:
        raise ValueError("no pages")
    out, starts = pdf_head(len(pages))
    parts, size = [out], len(out)
    for i, page in enumerate(pages):
        data, at = pdf_page(i, *page, dpi)
        starts += [size + x for x in at]
        size += len(data)
        parts.append(data)
    return b"".join([*parts, pdf_tail(starts, size)])


PART = "data binary, starts array<long>, error string"


def searchable_pdf_parts(docs: DataFrame, pages: DataFrame, dpi: int = 200) -> DataFrame:
    """(doc_id, ord, data, error): parts that make each document's searchable PDF one after the other; see searchable_pdfs().

    A part is a page, before all the head, after all the table of places, which is a running sum of the parts' sizes. So a task
    holds one page at a time, however many a document has. A page that fails gives its error in a row without data; such a
    document's PDF is not to be used, nor that of one without pages, which has one row with that error.
    """
    order = Window.partitionBy("doc_id").orderBy("page")
    numbered = pages.select("doc_id", "page", "image", "text", (F.row_number().over(order) - 1).alias("i"))

    @F.pandas_udf(PART)
    def page_part(numbers: pd.Series, images: pd.DataFrame, texts: pd.Series) -> pd.DataFrame:
        out = []
        for i, image, text in zip(numbers, images.itertuples(index=False), texts, strict=True):
            try:
                rgb = unpacked(image.height, image.width, image.nChannels, image.data)[:, :, ::-1].tobytes()
                out.append((*pdf_page(i, image.width, image.height, rgb, text, dpi), None))
            except Exception as e:
                out.append((None, None, message(e)))
        return pd.DataFrame(out, columns=["data", "starts", "error"], dtype=object)

    @F.pandas_udf("head binary, tail binary")
    def ends(counts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for n, at, size in zip(counts, starts, sizes, strict=True):
            head, first = pdf_head(n)
            out.append((head, pdf_tail(first + [len(head) + int(x) for x in at], len(head) + int(size))))
        return pd.DataFrame(out, columns=["head", "tail"], dtype=object)

    image = F.struct("image.height", "image.width", "image.nChannels", "image.data")
    made = numbered.withColumn("r", page_part("i", image, "text")).select("doc_id", F.col("i").alias("ord"), "r.*")
    # the pages are made once; from here on their rows are read
    folder = shared_folder(docs.sparkSession, "pages")
    made.write.parquet(folder)
    made = docs.sparkSession.read.schema(made.schema).parquet(folder)
    # only sizes and places meet; the pages' bytes stay in their rows
    size = F.coalesce(F.length("data").cast("long"), F.lit(0))
    before = F.sum(size).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    sizes = made.select("doc_id", "ord", "starts", size.alias("size"), F.coalesce(before, F.lit(0)).alias("before"))
    places = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("size").alias("size"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "before", "starts"))), lambda x: F.transform(F.coalesce(x["starts"], F.array().cast("array<long>")), lambda s: s + x["before"]))).alias("at"))
    both = docs.select("doc_id").join(places, "doc_id", "left")
    whole = both.where("n is not null").withColumn("r", ends("n", "at", "size"))
    none = F.lit(None).cast("string").alias("error")
    edges = whole.select("doc_id", F.inline(F.array(F.struct(F.lit(-1).alias("ord"), F.col("r.head").alias("data"), none), F.struct(F.col("n").alias("ord"), F.col("r.tail").alias("data"), none))))
    empty = both.where("n is null").select("doc_id", F.lit(0).alias("ord"), F.lit(None).cast("binary").alias("data"), F.lit("no pages").alias("error"))
    return made.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "ord", "data", "error").union(edges).union(empty)


def write_parts(parts: DataFrame, root: str, tasks: int) -> None:
    """Parts (doc_id, ord, data, error) as a table in which a document's lie in order, so that a reader streams them one by one."""
    parts.repartitionByRange(tasks, "doc_id", "ord").sortWithinPartitions("doc_id", "ord").write.parquet(root)


def read_file(spark: SparkSession, root: str, doc_id) -> Iterator[bytes]:
    """The bytes of a file that write_parts() left, part after part; one that failed raises ValueError."""
    mine = spark.read.parquet(root).where(F.col("doc_id") == F.lit(doc_id))
    if failed := mine.where("error is not null").select("error").first():
        raise ValueError(failed[0])
    for row in mine.orderBy("ord").select("data").toLocalIterator():
        yield bytes(row["data"])


def searchable_pdfs(docs: DataFrame, pages: DataFrame, dpi: int = 200) -> DataFrame:
    """(doc_id, data, error) of docs (doc_id) with pages (doc_id, page, image, text), image as Spark's image source gives it: pages in order, no pages an error."""
    fields = F.struct("page", "image.height", "image.width", "image.nChannels", "image.data", "text")
    ordered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("p"))

    @F.pandas_udf("data binary, error string")
    def run(groups: pd.Series) -> pd.DataFrame:
        out = []
        for group in groups:
            try:
                made = []
                for p in [] if group is None else group:
                    image = unpacked(p["height"], p["width"], p["nChannels"], p["data"])
                    made.append((p["width"], p["height"], image[:, :, ::-1].tobytes(), p["text"]))
                out.append((pdf_of_scans(made, dpi), None))
            except Exception as e:
                out.append((None, message(e)))
        return pd.DataFrame(out, columns=["data", "error"], dtype=object)

    return docs.select("doc_id").join(ordered, "doc_id", "left").withColumn("r", run("p")).select("doc_id", "r.data", "r.error")


def answer(body: Column) -> Column:
    """The text of a JSON answer."""
    return F.decode(body, "utf-8")


def as_json(value) -> bytes:
    return json.dumps(value).encode()

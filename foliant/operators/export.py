"""Export: layout as rows (blocks, cells, lines, pages) and writers that turn them into PDF, DOCX and XLSX bytes."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import NL, default, strip

#: Page geometry in points, characters of a line, and sizes of pictures (fixed values).
WIDTH, HEIGHT, FONT, LEADING, LEFT, TOP, BOTTOM = 612, 792, 10, 14, 40, 742, 40
LINE_CHARS, PAGE_LINES = 100, int((TOP - BOTTOM) / LEADING)
DOCX_INCHES, DPI, XLSX_PIXELS, FIGURE_ROWS = 6.0, 96.0, 600, 24
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
#: Files that a task hands on at once.
FILES = 64
RULED = "ruled_line_region"
NOTE = "Detected as a ruled table on a scanned page but not parsed into a grid; raw region text follows."
IMAGE = "struct<storage_key:string,bbox:array<double>,page:int,source:string,region_type_guess:string,width:int,height:int,format:string>"


def gate(status: Column, format_: Column) -> Column:
    """The outcome code of an export request: 404 unknown document (null status), 409 not done, 422 unknown format, else 200."""
    return F.when(~F.coalesce(format_.isin(*MIME), F.lit(False)), 422).when(status.isNull(), 404).when(status != "DONE", 409).otherwise(200)


def pdf_strategy(text_source: Column, original: Column, searchable: Column) -> Column:
    """Which bytes serve a PDF export: original where it is readable and a PDF of native text, searchable of scans, else render."""
    is_pdf = F.coalesce(F.substring(original, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return F.when((text_source == "native_pdf") & is_pdf, "original").when((text_source == "ocr") & searchable.isNotNull(), "searchable").otherwise("render")


def filename(id_: Column, format_: Column) -> Column:
    return F.concat(id_.cast("string"), F.lit("."), format_)


def mime(format_: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in MIME.items():
        out = F.when(format_ == k, v).otherwise(out)
    return out


def figures(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """images (key, ord, page, bbox, source, region_type_guess, …) with n, their place in reading order, and caption.

    Order: page (null is 0), top edge (0 where it is missing), then as given.
    """
    top = F.coalesce(F.get("bbox", F.lit(1)), F.lit(0.0))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("page", F.lit(0)), top, "ord"))
    return images.withColumn("n", n).withColumn("caption", F.format_string("Figure %d (page %d, %s: %s)", F.col("n"), F.coalesce("page", F.lit(0)) + 1, default(F.col("source"), "?"), default(F.col("region_type_guess"), "unknown")))


def docx_width(pixels: Column) -> Column:
    """Inches of a figure."""
    return F.when(F.coalesce(pixels, F.lit(0)) > 0, F.least(F.lit(DOCX_INCHES), pixels / F.lit(DPI))).otherwise(F.lit(DOCX_INCHES))


def xlsx_size(width: Column, height: Column) -> Column:
    """struct<width,height> of a figure in pixels, no wider than the sheet's column of pictures."""
    scale = F.lit(float(XLSX_PIXELS)) / width
    wide = width > XLSX_PIXELS
    return F.struct(F.when(wide, (width * scale).cast("int")).otherwise(width).alias("width"), F.when(wide, (height * scale).cast("int")).otherwise(height).alias("height"))


def _rows(docs: DataFrame, *parts: Column) -> DataFrame:
    """One row for each element of the parts' arrays one after the other, numbered."""
    return docs.select("doc_id", F.posexplode(F.flatten(F.array(*parts))).alias("ord", "x")).select("doc_id", "ord", "x.*")


def _heads(docs: DataFrame) -> tuple[Column, Column, Column, Column]:
    images = F.col("figures") if "figures" in docs.columns else F.array().cast("array<struct<caption:string,width:int,height:int,format:string,bbox:array<double>,data:binary>>")
    return F.col("structure.sections"), F.col("structure.tables"), images, F.coalesce("source", F.lit(""))


def _empty(docs: DataFrame) -> Column:
    s, t, f, _ = _heads(docs)
    return (F.coalesce(F.size(s), F.lit(0)) <= 0) & (F.coalesce(F.size(t), F.lit(0)) <= 0) & (F.coalesce(F.size(f), F.lit(0)) <= 0)


def docx_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, level, text, cells) of docs (doc_id, source, structure[, figures<caption,width,data>]) in the order of the file.

    kind: heading, paragraph, note, bold, picture or grid; a grid's rows are padded to the widest.
    """
    s, t, f, source = _heads(docs)
    none = F.lit(None).cast("array<array<string>>")

    def block(kind, text, level=None, cells=none):
        return F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), text.cast("string").alias("text"), cells.alias("cells"))

    def when(c, *blocks):
        return F.when(c, F.array(*blocks)).otherwise(F.array().cast("array<struct<kind:string,level:int,text:string,cells:array<array<string>>>>"))

    def of_section(x):
        return F.concat(F.array(block("heading", F.coalesce(x["title"], F.lit("General")), 3)), when(F.coalesce(x["content"], F.lit("")) != "", block("paragraph", x["content"])))

    def of_table(x, i):
        n = (i + 1).cast("string")
        width = F.array_max(F.transform(x["rows"], F.size))
        grid = F.transform(x["rows"], lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        blob = F.array(block("heading", F.concat(F.lit("Table "), n, F.lit(" (detected, unstructured)")), 3), block("note", F.lit(NOTE)), block("paragraph", default(strip(F.coalesce(x["region_text"], F.lit(""))), "(no text)")))
        body = F.when(F.coalesce(F.size(x["rows"]), F.lit(0)) > 0, F.array(block("grid", F.lit(None), None, grid))).otherwise(F.array(block("paragraph", F.lit("(empty table)"))))
        return F.when(F.coalesce(x["source"] == RULED, F.lit(False)), blob).otherwise(F.concat(F.array(block("heading", F.concat(F.lit("Table "), n), 3)), body))

    def of_figure(x, i):
        missing = F.concat(F.lit("[Figure "), (i + 1).cast("string"), F.lit(": image data unavailable]"))
        return F.array(block("bold", x["caption"]), F.when(x["data"].isNull(), block("paragraph", missing)).otherwise(block("picture", docx_width(x["width"]).cast("string"))))

    return _rows(
        docs,
        F.array(block("heading", source, 1)),
        F.when(F.size(s) > 0, F.concat(F.array(block("heading", F.lit("Sections"), 2)), F.flatten(F.transform(s, of_section)))).otherwise(when(F.lit(False), block("paragraph", source))),
        F.when(F.size(f) > 0, F.concat(F.array(block("heading", F.lit("Figures"), 2)), F.flatten(F.transform(f, of_figure)))).otherwise(when(F.lit(False), block("paragraph", source))),
        F.when(F.size(t) > 0, F.concat(F.array(block("heading", F.lit("Tables"), 2)), F.flatten(F.transform(t, of_table)))).otherwise(when(F.lit(False), block("paragraph", source))),
        when(_empty(docs), block("paragraph", F.lit("(no structured data extracted)"))),
    )


def xlsx_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, col, value, bold) of the workbook; rows count from 1.

    Sheet Sections is always there; Tables and Figures only where there are some. A region without a grid is one merged,
    wrapped cell under its label.
    """
    s, t, f, source = _heads(docs)
    cell = "array<struct<sheet:string,row:int,values:array<string>,bold:boolean>>"
    none = F.array().cast(cell)

    def line(sheet, row, values, bold=False):
        return F.struct(F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), values.alias("values"), F.lit(bold).alias("bold"))

    sections = F.concat(F.array(line("Sections", F.lit(1), F.array(F.lit("Source"), source)), line("Sections", F.lit(3), F.array(F.lit("Title"), F.lit("Content")))), F.coalesce(F.transform(s, lambda x, i: line("Sections", i + 4, F.array(F.coalesce(x["title"], F.lit("General")), F.coalesce(x["content"], F.lit(""))))), none))
    ruled = lambda x: F.coalesce(x["source"] == RULED, F.lit(False))
    height = lambda x: F.when(ruled(x), 4).otherwise(F.coalesce(F.size(x["rows"]), F.lit(0)) + 2)

    def of_table(x, i):
        first = F.aggregate(F.slice(t, F.lit(1), i), F.lit(1), lambda a, y: a + height(y))
        n = (i + 1).cast("string")
        blob = F.array(line("Tables", first, F.array(F.concat(F.lit("Table "), n, F.lit(" - detected ruled region (unstructured text, not a grid)"))), True), line("Tables", first + 1, F.array(strip(F.coalesce(x["region_text"], F.lit(""))))))
        grid = F.concat(F.array(line("Tables", first, F.array(F.concat(F.lit("Table "), n, F.lit(" ("), default(x["source"], "heuristic"), F.lit(")"))), True)), F.coalesce(F.transform(x["rows"], lambda r, k: line("Tables", first + k + 1, r)), none))
        return F.when(ruled(x), blob).otherwise(grid)

    def of_figure(x, i):
        first = i * FIGURE_ROWS + 2
        state = F.when(x["data"].isNull(), F.lit("[image data unavailable]")).otherwise(F.lit("[picture]"))
        known = lambda c: F.coalesce(x[c].cast("string"), F.lit("?"))
        box = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(x["bbox"], lambda v: v.cast("string")), ", "), F.lit("]")), F.lit("None"))
        about = F.concat(F.lit("size "), known("width"), F.lit("x"), known("height"), F.lit(" format "), known("format"), F.lit(" bbox "), box)
        return F.array(line("Figures", first, F.array(x["caption"]), True), line("Figures", first + 1, F.array(about)), line("Figures", first + 2, F.array(state)))

    tables = F.when(F.size(t) > 0, F.flatten(F.transform(t, of_table))).otherwise(none)
    pictures = F.when(F.size(f) > 0, F.concat(F.array(line("Figures", F.lit(1), F.array(F.lit("Extracted images - one block per figure, in page/reading order.")))), F.flatten(F.transform(f, of_figure)))).otherwise(none)
    rows = docs.select("doc_id", F.explode(F.concat(sections, tables, pictures)).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "sheet", "row", F.posexplode("values").alias("col", "value"), "bold").withColumn("col", F.col("col") + 1)


def flat_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, line): the text that the fallback PDF shows."""
    s, t, f, source = _heads(docs)
    one = lambda x: F.array(F.struct(x.alias("line")))
    none = F.array().cast("array<struct<line:string>>")
    text_lines = lambda x: F.transform(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), NL), strip), lambda y: y != ""), lambda y: F.struct(F.concat(F.lit("    "), y).alias("line")))

    def part(head, items, each, tail=None):
        closing = [one(F.lit(tail))] if tail else []
        return F.when(F.size(items) > 0, F.concat(one(F.lit(head)), F.flatten(F.transform(items, each)), *closing, one(F.lit("")))).otherwise(none)

    number = lambda i: F.concat(F.lit("- Table "), (i + 1).cast("string"))
    of_section = lambda x: F.concat(one(F.concat(F.lit("- "), F.coalesce(x["title"], F.lit("General")))), text_lines(x["content"]))
    of_table = lambda x, i: F.when(F.coalesce(x["source"] == RULED, F.lit(False)), F.concat(one(F.concat(number(i), F.lit(" (detected, unstructured)"))), text_lines(x["region_text"]))).otherwise(F.concat(one(number(i)), F.coalesce(F.transform(x["rows"], lambda r: F.struct(F.concat(F.lit("    "), F.array_join(r, " | ")).alias("line"))), none)))
    of_figure = lambda x: one(F.concat(F.lit("- "), x["caption"]))
    return _rows(
        docs,
        F.concat(one(F.concat(F.lit("Source: "), source)), one(F.lit(""))),
        part("SECTIONS", s, of_section),
        part("TABLES", t, of_table),
        part("IMAGES", f, of_figure, "(image bytes are embedded in the docx / xlsx exports, not this PDF)"),
        F.when(_empty(docs), one(F.lit("(no structured data extracted)"))).otherwise(none),
    )


def wrapped(line: Column) -> Column:
    """Chunks of LINE_CHARS characters; an empty line is one chunk."""
    n = F.greatest(F.lit(0), F.floor((F.length(line) - 1) / LINE_CHARS).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(line, i * LINE_CHARS + 1, F.lit(LINE_CHARS)))


def pdf_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, at, line) of flat_lines(): wrapped, and dealt to pages of PAGE_LINES lines."""
    chunks = lines.select("doc_id", "ord", F.posexplode(wrapped(F.col("line"))).alias("k", "line"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")) - 1
    return chunks.select("doc_id", F.floor(n / PAGE_LINES).cast("int").alias("page"), (n % PAGE_LINES).alias("at"), "line")


def pdf_escaped(line: Column) -> Column:
    """As a PDF string's inside: backslash and parentheses escaped, characters beyond Latin-1 as ?."""
    x = F.replace(F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))
    return F.regexp_replace(x, r"[^\x00-\xFF]", "?")


# writers: small files of one document each, built from its rows


def pdf_bytes(pages: list[list[str]]) -> bytes:
    """A PDF of pages of escaped lines."""
    out, offsets = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    n = len(pages)

    def put(body: bytes) -> None:
        offsets.append(out.tell())
        out.write(b"%d 0 obj\n" % len(offsets) + body + b"\nendobj\n")

    put(b"<< /Type /Catalog /Pages 2 0 R >>")
    put(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n))))
    put(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    for i, lines in enumerate(pages):
        put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, 5 + 2 * i))
        shown = "\nT*\n".join(f"({x}) Tj" for x in lines)
        stream = f"BT\n/F1 {FONT} Tf\n{LEADING} TL\n{LEFT} {TOP} Td\n{shown}\nET".encode("latin-1", "replace")
        put(b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream")
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % x for x in offsets))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, start))
    return out.getvalue()


def _zipped(files: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text if isinstance(text, bytes) else '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def picture_kind(data: bytes) -> tuple[str, int, int]:
    """Format, width and height of a PNG or JPEG, from its header; ValueError for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 33:
        return "png", int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return "jpeg", int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        at += 2 + size
    raise ValueError("neither PNG nor JPEG")


def _embeddable(data: bytes, reencode: Callable[[bytes], bytes] | None) -> tuple[bytes, str, int, int]:
    """data, or what reencode makes of it if it is of another format, with its format and size."""
    try:
        return data, *picture_kind(data)
    except ValueError:
        if reencode is None:
            raise
    data = reencode(data)
    return data, *picture_kind(data)


_A = "http://schemas.openxmlformats.org/drawingml/2006"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_EMU = 914400


def _graphic(k: int, cx: int, cy: int, outer: str) -> str:
    """The picture of relationship p{k}, so large; outer is the prefix of its element."""
    shape = f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
    inside = f'<pic:nvPicPr><pic:cNvPr id="{k}" name="Figure {k}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="p{k}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>{shape}'
    return f'<pic:pic xmlns:pic="{_A}/picture">{inside}</pic:pic>' if outer == "pic" else f"<{outer}:pic>{inside.replace('pic:', outer + ':')}</{outer}:pic>"


def _pictures(pictures: dict[int, tuple[bytes, str]], folder: str) -> tuple[dict[str, bytes], str, str]:
    """Media files of pictures by number, their relationships, and the content types that they need."""
    media = {f"{folder}/media/figure{k}.{kind}": data for k, (data, kind) in pictures.items()}
    base = "../media" if folder == "xl" else "media"
    links = "".join(f'<Relationship Id="p{k}" Type="{_R}/image" Target="{base}/figure{k}.{kind}"/>' for k, (_, kind) in pictures.items())
    return media, links, "".join(f'<Default Extension="{kind}" ContentType="image/{kind}"/>' for kind in sorted({kind for _, kind in pictures.values()}))


_CLEAN = {c: None for c in range(32) if c not in (9, 10, 13)}


def _xml(text) -> str:
    return escape((text or "").translate(_CLEAN))


def docx_bytes(blocks: list[dict], figures: list[dict] | None = None, reencode: Callable[[bytes], bytes] | None = None) -> bytes:
    """A DOCX of docx_blocks() rows; figures: n and data of the pictures, which follow their captions in that order.

    A picture that can't be embedded, nor what reencode makes of it, is a note.
    """
    w = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="{_R}" xmlns:wp="{_A}/wordprocessingDrawing" xmlns:a="{_A}/main"'
    run = lambda text, props="": f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{_xml(text)}</w:t></w:r>'
    left = [f for f in sorted(figures or [], key=lambda f: f["n"]) if f["data"] is not None]
    body, pictures = [], {}
    for b in blocks:
        if b["kind"] == "heading":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading{b["level"]}"/></w:pPr>{run(b["text"])}</w:p>')
        elif b["kind"] == "grid":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in b["cells"])
            body.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>{rows}</w:tbl><w:p/>')
        elif b["kind"] == "picture" and left:
            figure = left.pop(0)
            k = int(figure["n"])
            try:
                data, kind, width, height = _embeddable(bytes(figure["data"]), reencode)
                cx = round(float(b["text"]) * _EMU)
                cy = round(cx * height / max(width, 1))
                pictures[k] = data, kind
                graphic = f'<a:graphic><a:graphicData uri="{_A}/picture">{_graphic(k, cx, cy, "pic")}</a:graphicData></a:graphic>'
                body.append(f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{k}" name="Figure {k}"/>{graphic}</wp:inline></w:drawing></w:r></w:p>')
            except Exception as e:
                body.append(f"<w:p>{run(f'[Figure {k}: could not embed image ({e})]')}</w:p>")
        else:
            body.append(f'<w:p>{run(b["text"], {"bold": "<w:b/>", "note": "<w:i/>"}.get(b["kind"], ""))}</w:p>')
    media, links, types = _pictures(pictures, "word")
    return _zipped({
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>",
        **({"word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'} if links else {}), **media,
    })


def _letter(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_bytes(cells: list[dict], figures: list[dict] | None = None) -> bytes:
    """An XLSX of xlsx_cells() rows, with inline strings; figures: n and data of the pictures, which stand where their cells are.

    A picture that can't be embedded leaves a note in its cell.
    """
    pictures, anchors = {}, []
    places = {f["n"]: (f["n"] - 1) * FIGURE_ROWS + 4 for f in figures or [] if f["data"] is not None}
    for f in figures or []:
        if f["data"] is None:
            continue
        cell = next((c for c in cells if c["sheet"] == "Figures" and c["row"] == places[f["n"]] and c["col"] == 1), None)
        try:
            data, kind, width, height = _embeddable(bytes(f["data"]), None)
            shrink = min(1.0, XLSX_PIXELS / max(width, 1))
            pictures[int(f["n"])] = data, kind
            anchors.append((int(f["n"]), places[f["n"]] - 1, int(width * shrink) * 9525, int(height * shrink) * 9525))
            cells = [c for c in cells if c is not cell]
        except Exception:
            cells = [c | {"value": "[image could not be embedded]"} if c is cell else c for c in cells]
    names = [n for n in ("Sections", "Tables", "Figures") if any(c["sheet"] == n for c in cells)]
    main, doc = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{doc}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rs" Type="{doc}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    for i, name in enumerate(names, 1):
        rows: dict[int, list[dict]] = {}
        for c in cells:
            if c["sheet"] == name:
                rows.setdefault(c["row"], []).append(c)
        put = lambda c: f'<c r="{_letter(c["col"])}{c["row"]}" t="inlineStr"{" s=\"1\"" if c["bold"] else ""}><is><t xml:space="preserve">{_xml(c["value"])}</t></is></c>'
        data = "".join(f'<row r="{r}">' + "".join(put(c) for c in sorted(cs, key=lambda c: c["col"])) + "</row>" for r, cs in sorted(rows.items()))
        drawing = f'<drawing xmlns:r="{_R}" r:id="d1"/>' if name == "Figures" and pictures else ""
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData>{drawing}</worksheet>'
        if drawing:
            package = "http://schemas.openxmlformats.org/package/2006/relationships"
            media, links, types = _pictures(pictures, "xl")
            anchor = lambda k, row, cx, cy: f'<x:oneCellAnchor><x:from><x:col>0</x:col><x:colOff>0</x:colOff><x:row>{row}</x:row><x:rowOff>0</x:rowOff></x:from><x:ext cx="{cx}" cy="{cy}"/>{_graphic(k, cx, cy, "x")}<x:clientData/></x:oneCellAnchor>'
            files[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = f'<Relationships xmlns="{package}"><Relationship Id="d1" Type="{_R}/drawing" Target="../drawings/drawing1.xml"/></Relationships>'
            files["xl/drawings/drawing1.xml"] = f'<x:wsDr xmlns:x="{_A}/spreadsheetDrawing" xmlns:a="{_A}/main" xmlns:r="{_R}">{"".join(anchor(*a) for a in anchors)}</x:wsDr>'
            files["xl/drawings/_rels/drawing1.xml.rels"] = f'<Relationships xmlns="{package}">{links}</Relationships>'
            overrides = f'{types}<Override PartName="/xl/drawings/drawing1.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/></Types>'
            files["[Content_Types].xml"] = files["[Content_Types].xml"].replace("</Types>", overrides)
            files |= media
    return _zipped(files)


def render(docs: DataFrame, format_: str, reencode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(doc_id, filename, mime, bytes) of each document; an unknown format is an error.

    reencode makes a PNG of a picture of another format, for DOCX.
    """
    if format_ not in MIME:
        raise ValueError(f"unknown export format: {format_!r}")
    if format_ == "pdf":
        rows = pdf_pages(flat_lines(docs)).withColumn("line", pdf_escaped(F.col("line")))
    else:
        rows = docx_blocks(docs) if format_ == "docx" else xlsx_cells(docs)

    def build(rows: list[dict], figures: list[dict]) -> bytes:
        if format_ == "pdf":
            rows = sorted(rows, key=lambda r: (r["page"], r["at"]))
            return pdf_bytes([[r["line"] for r in page] for _, page in itertools.groupby(rows, key=lambda r: r["page"])])
        if format_ == "docx":
            return docx_bytes(sorted(rows, key=lambda r: r["ord"]), figures, reencode)
        return xlsx_bytes(rows, figures)

    def files(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILES):
                some = batch.slice(i, FILES)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([build(r.as_py(), []) for r in some.column(1)], pa.binary())], names=["doc_id", "bytes"])

    def with_figures(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        figures = [{"n": int(r["n"]), "data": r["data"]} for r in found.to_dict("records")]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "bytes": [build(pdf.to_dict("records"), figures)]})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bytes binary"
    if format_ == "pdf" or "figures" not in docs.columns:
        made = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias("rows")).mapInArrow(files, schema)
    else:
        pictures = docs.select(F.col("doc_id").alias("of"), F.posexplode("figures").alias("n", "f")).select("of", (F.col("n") + 1).alias("n"), "f.data")
        made = rows.groupBy("doc_id").cogroup(pictures.groupBy("of")).applyInPandas(with_figures, schema)
    return made.select("doc_id", filename(F.col("doc_id"), F.lit(format_)).alias("filename"), F.lit(MIME[format_]).alias("mime"), "bytes")

"""Sections and tables of document texts.

A document becomes rows of lines; one shuffle on the document serves the look at the previous line and
both running counts, and the regrouping. parse_structure, for the nested result, keeps a document's lines in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import GENERAL, NL, default, is_header, is_table_row, row_cells, strip, strip_end, title_of

TABLE = "struct<source:string,raw_lines:array<string>,rows:array<array<string>>,bbox:array<int>,region_text:string>"
SECTION = "struct<title:string,content:string>"
LEAST_ROWS = LEAST_COLUMNS = 2
#: Parts sections and tables while a document's lines stand in one text. Like the line break it is one of NL, so no line holds it.
BLOCK = "\x1d"


def lines(docs: DataFrame, heuristic: Column | bool = True) -> DataFrame:
    """Rows (doc_id, pos, raw, s, is_table, is_header, part, island) of all lines that aren't blank.

    part counts the headers so far, island the lines so far that are in no table. heuristic: whether aligned lines are
    table rows, a boolean or a column of docs. Null or empty text has no lines.
    """
    on = heuristic if isinstance(heuristic, Column) else F.lit(heuristic)
    rows = docs.select("doc_id", on.alias("on"), F.posexplode(F.split("text", NL)).alias("pos", "raw")).withColumn("s", strip(F.col("raw")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = rows.withColumn("before", F.lag("s").over(w)).where("s <> ''").withColumn("is_table", F.col("on") & is_table_row(F.col("s")))
    flagged = flagged.withColumn("is_header", ~F.col("is_table") & is_header(F.col("s"), F.col("before")))
    count = lambda c: F.sum(c.cast("long")).over(so_far)
    return flagged.select("doc_id", "pos", strip_end(F.col("raw")).alias("raw"), "s", "is_table", "is_header", count(F.col("is_header")).alias("part"), count(~F.col("is_table")).alias("island"))


def _joined(name: str, condition: Column) -> Column:
    """The lines that meet a condition, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("pos", name)))), lambda x: x[name])


def sections(rows: DataFrame) -> DataFrame:
    """(doc_id, part, title, content) of lines(); a preamble without content is none, a header without content is."""
    body = ~F.col("is_table") & ~F.col("is_header")
    grouped = rows.where("not is_table").groupBy("doc_id", "part").agg(F.max(F.when(F.col("is_header"), title_of(F.col("s")))).alias("title"), F.array_join(_joined("s", body), "\n").alias("content"))
    return grouped.where("part > 0 or content <> ''").select("doc_id", "part", F.coalesce("title", F.lit(GENERAL)).alias("title"), "content")


def heuristic_tables(rows: DataFrame) -> DataFrame:
    """(doc_id, table_no, raw_lines, rows) of maximal runs of table rows; blank lines don't break a run."""
    found = rows.where("is_table").groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "s"))).alias("l"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("island"))
    return found.select("doc_id", number.alias("table_no"), F.transform("l", lambda x: x["raw"]).alias("raw_lines"), F.transform("l", lambda x: row_cells(x["s"])).alias("rows"))


def clean_native_tables(tables: Column) -> Column:
    """array<array<array<string>>> of recovered grids to table structs: ill-formed grids and spurious rows go, then tables with too few rows."""
    filled = lambda r: F.filter(r, lambda c: F.coalesce(strip(c), F.lit("")) != "")
    formed = F.filter(tables, lambda t: (F.size(t) >= LEAST_ROWS) & (F.size(F.get(t, F.lit(0))) >= LEAST_COLUMNS) & F.forall(t, lambda r: F.coalesce(F.size(r) == F.size(F.get(t, F.lit(0))), F.lit(False))))
    keep = lambda r: (F.size(filled(r)) > 1) | ((F.size(filled(r)) == 1) & ~F.coalesce(F.get(filled(r), F.lit(0)).contains("\n"), F.lit(False)))
    cleaned = F.filter(F.transform(formed, lambda t: F.filter(t, keep)), lambda t: F.size(t) >= LEAST_ROWS)
    cells = F.transform(cleaned, lambda t: F.transform(t, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))))
    return F.transform(cells, lambda t: F.struct(F.lit("native_pdf").alias("source"), F.transform(t, lambda r: F.array_join(r, " | ")).alias("raw_lines"), t.alias("rows"), F.lit(None).cast("array<int>").alias("bbox"), F.lit(None).cast("string").alias("region_text")).cast(TABLE))


def clean_ruled_regions(regions: Column) -> Column:
    """array<struct<bbox,region_text,…>> of ruled regions to table structs; those without text go, pages are not kept."""
    kept = F.filter(regions, lambda r: F.coalesce(strip(r["region_text"]), F.lit("")) != "")
    return F.transform(kept, lambda r: F.struct(F.lit("ruled_line_region").alias("source"), F.lit(None).cast("array<string>").alias("raw_lines"), F.lit(None).cast("array<array<string>>").alias("rows"), r["bbox"].alias("bbox"), r["region_text"].alias("region_text")).cast(TABLE))


def parse_structure(docs: DataFrame) -> DataFrame:
    """doc_id, structure<sections, tables> for docs (doc_id, text[, native_tables][, ruled_regions][, text_source]).

    Grids given win over regions given, and both over aligned lines, judged before cleaning; aligned lines are no tables
    where text_source is `ocr`. Documents without lines get empty arrays. Nothing moves: each row of docs is a document of its own.
    """
    have = {c: F.col(c) if c in docs.columns else F.lit(None).cast(t) for c, t in (("native_tables", "array<array<array<string>>>"), ("ruled_regions", "array<struct<bbox:array<int>,page:int,region_text:string,source:string>>"), ("text_source", "string"))}
    docs = docs.withColumns(have)
    native, ruled = F.coalesce(F.size("native_tables") > 0, F.lit(False)), F.coalesce(F.size("ruled_regions") > 0, F.lit(False))
    on = (default(F.col("text_source"), "") != "ocr") & ~native & ~ruled
    both = F.transform(F.split("text", NL), lambda raw: F.struct(strip_end(raw).alias("raw"), strip(raw).alias("s")))
    rows = docs.select("doc_id", "native_tables", "ruled_regions", on.alias("on"), both.alias("l"))
    # each line beside the one before it; the last place has none
    before = F.concat(F.array(F.lit(None).cast("struct<raw:string,s:string>")), F.col("l"))
    beside = F.filter(F.zip_with("l", before, lambda x, b: F.struct(x["raw"].alias("raw"), x["s"].alias("s"), b["s"].alias("before"))), lambda x: x["s"] != "")
    in_table = lambda x: F.col("on") & is_table_row(x["s"])
    flagged = F.transform(beside, lambda x: F.struct(x["raw"], x["s"], in_table(x).alias("is_table"), (~in_table(x) & is_header(x["s"], x["before"])).alias("is_header")))
    rows = rows.select("doc_id", "native_tables", "ruled_regions", flagged.alias("l"))
    # sections: one text, in which headers begin blocks
    text = F.array_join(F.transform(F.filter("l", lambda x: ~x["is_table"]), lambda x: F.when(x["is_header"], F.concat(F.lit(BLOCK), x["s"])).otherwise(x["s"])), "\n")
    part = lambda title, content: F.struct(title.alias("title"), content.alias("content")).cast(SECTION)
    headed = lambda p: part(title_of(F.substring_index(p, "\n", 1)), F.coalesce(F.get(F.split(p, "\n", 2), F.lit(1)), F.lit("")))
    parts = F.transform(F.split(text, f"\n?{BLOCK}"), lambda p, i: F.when(i == 0, part(F.lit(GENERAL), p)).otherwise(headed(p)))
    parts = F.coalesce(F.filter(parts, lambda x, i: (i > 0) | (x["content"] != "")), F.array().cast(f"array<{SECTION}>"))
    # tables: one text, in which what is no table's line ends a block
    text = F.array_join(F.transform("l", lambda x: F.when(x["is_table"], x["raw"]).otherwise(BLOCK)), "\n")
    blocks = F.filter(F.transform(F.split(text, BLOCK), lambda p: F.btrim(p, F.lit("\n"))), lambda p: p != "")
    guessed = F.transform(blocks, lambda p: F.struct(F.lit("heuristic").alias("source"), F.split(p, "\n").alias("raw_lines"), F.transform(F.split(p, "\n"), lambda raw: row_cells(strip(raw))).alias("rows"), F.lit(None).cast("array<int>").alias("bbox"), F.lit(None).cast("string").alias("region_text")).cast(TABLE))
    tables = F.when(native, clean_native_tables(F.col("native_tables"))).when(ruled, clean_ruled_regions(F.col("ruled_regions"))).otherwise(F.coalesce(guessed, F.array().cast(f"array<{TABLE}>")))
    return rows.select("doc_id", F.struct(parts.alias("sections"), tables.alias("tables")).alias("structure"))

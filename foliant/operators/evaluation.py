"""Evaluation reports: confidence, flags, categories, statistics overall and by category in one pass, and their text."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip

LOW_CONFIDENCE, NEAR_EMPTY = 60.0, 20
NONE = "uncategorized"
FLAGS = ("low_confidence", "near_empty_output", "no_structure_detected", "request_failed")


def word_confidence(words: DataFrame) -> DataFrame:
    """(doc_id, confidence) of words (doc_id, level, text, conf string): the mean over word-level rows with text and a confidence of 0 or more; null if none."""
    conf = F.col("conf").try_cast("double")
    counted = (F.col("level") == 5) & (F.coalesce(strip(F.col("text")), F.lit("")) != "") & (conf >= 0)
    return words.groupBy("doc_id").agg(F.avg(F.when(counted, conf)).alias("confidence"))


def flags(confidence: Column, text: Column, sections: Column, tables: Column, failed: Column) -> Column:
    """array<string>; a failed request has that flag alone."""
    none = F.array().cast("array<string>")
    mark = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(none)
    low, near, bare, request = FLAGS
    usual = F.concat(mark(F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False)), low), mark(F.length(strip(F.coalesce(text, F.lit("")))) < NEAR_EMPTY, near), mark((sections == 0) & (tables == 0), bare))
    return F.when(failed, F.array(F.lit(request))).otherwise(usual)


def path_taken(name: Column, native_accepted: Column, failed: Column) -> Column:
    return F.when(failed, "error").when(F.lower(name).endswith(".pdf") & native_accepted, "native").otherwise("ocr")


def category(path: Column) -> Column:
    """Of a path under the root: its first folder, else the letters that start its name, else uncategorized."""
    folder = F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1)))
    start = F.regexp_extract(F.regexp_replace(path, r"\.[^.]*$", ""), r"^([A-Za-z_-]{3,})", 1)
    return F.coalesce(folder, F.nullif(F.lower(F.btrim(start, F.lit("_-"))), F.lit("")), F.lit(NONE))


def report(rows: DataFrame) -> DataFrame:
    """Statistics of rows (category, path_taken, seconds, confidence, flags, failed): one row for all (category null) and one for each category.

    Shares are of all rows, failed ones too. No rows: one row with count 0.
    """
    share = lambda name: (100.0 * F.count_if(F.array_contains("flags", name)) / F.nullif(F.count("*"), F.lit(0))).alias(f"pct_{name}")
    figures = [F.count("*").alias("docs"), F.count_if("failed").alias("errors"), F.count_if(F.col("path_taken") == "native").alias("native"), F.count_if(F.col("path_taken") == "ocr").alias("ocr"), F.avg("seconds").alias("avg_seconds"), F.avg("confidence").alias("avg_confidence"), *map(share, FLAGS[:3])]
    return rows.rollup("category").agg(F.grouping("category").alias("overall"), *figures)


def shown(value: Column, digits: int = 1, suffix: str = "") -> Column:
    """n/a for null, else fixed decimals; a value that reads as half-way rounds up."""
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.format_string(f"%.{digits}f", value), F.lit(suffix)))


def report_lines(stats: DataFrame) -> DataFrame:
    """(overall, category, line): rows of a Markdown table; the line for all comes first, categories follow in order."""
    cells = [F.when(F.col("overall") == 1, "**Overall**").otherwise(F.col("category")), *(F.col(c).cast("string") for c in ("docs", "errors", "native", "ocr")), shown(F.col("avg_seconds"), 2, "s"), *(shown(F.col(c), 1, "%") for c in ("avg_confidence", "pct_low_confidence", "pct_no_structure_detected", "pct_near_empty_output"))]
    return stats.select("overall", "category", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).orderBy(F.desc("overall"), "category")


def report_json(stats: DataFrame) -> DataFrame:
    """(overall, category, line): each row of statistics as a JSON object with its columns' names, nulls kept; the one for all comes first."""
    figures = F.struct(*(F.col(c) for c in stats.columns if c != "overall"))
    return stats.select("overall", "category", F.to_json(figures, {"ignoreNullFields": "false"}).alias("line")).orderBy(F.desc("overall"), "category")


def timed(call):
    """A column function of (name, content) as recognisers.isolated() makes it, that also measures seconds: struct<pages,error,seconds>."""
    from foliant.sources.recognisers import message

    @F.pandas_udf("pages array<string>, error string, seconds double")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, content in zip(names, contents, strict=True):
            began = time.perf_counter()
            try:
                pages, error = (None, None) if content is None else (list(call(name, bytes(content))), None)
            except Exception as e:
                pages, error = None, message(e)
            out.append((pages, error, None if content is None else time.perf_counter() - began))
        return pd.DataFrame(out, columns=["pages", "error", "seconds"], dtype=object)

    return run


def evaluate(files: DataFrame, native, recognise, confidence: DataFrame | None = None) -> DataFrame:
    """Rows for report() of files (path, name, content): each is read, timed, and structured, and its figures are taken anew.

    path is under the samples' root, and gives the category. native (or None) and recognise are Python functions of (name,
    content) that return page texts; what they raise is the file's error. confidence: (doc_id, confidence), as word_confidence()
    makes it; doc_id is the path. What was read is written to the shared folder first, so each file is recognised once.
    """
    from foliant.operators.structure import parse_structure
    from foliant.sources.files import is_pdf, native_text, scanned_text
    from foliant.sources.shared import shared_folder

    rows = files.select(F.col("path").alias("doc_id"), "name", "content").withColumn("_pdf", is_pdf(F.col("name"), F.col("content")))
    none = F.lit(None).cast("struct<pages:array<string>,error:string,seconds:double>")
    rows = rows.withColumn("_n", timed(native)("name", F.when(F.col("_pdf"), F.col("content"))) if native else none)
    rows = rows.withColumn("_text", F.when(F.col("_pdf"), native_text(F.col("_n.pages"))))
    rows = rows.withColumn("_r", timed(recognise)("name", F.when(F.col("_text").isNull(), F.col("content"))))
    text, used = F.coalesce("_text", scanned_text(F.col("_r.pages"))), F.col("_text").isNotNull()
    read = rows.select("doc_id", "name", text.alias("text"), used.alias("native"), text.isNull().alias("failed"), F.coalesce("_r.error", F.when(text.isNull(), F.lit("nothing was recognised"))).alias("error"), (F.coalesce("_n.seconds", F.lit(0.0)) + F.coalesce("_r.seconds", F.lit(0.0))).alias("seconds"))
    folder = shared_folder(files.sparkSession, "read")
    read.write.parquet(folder)
    read = files.sparkSession.read.schema(read.schema).parquet(folder)
    parsed = parse_structure(read.select("doc_id", "text", F.when(~F.col("native"), "ocr").alias("text_source")))
    out = read.join(parsed, "doc_id", "left")
    out = out.withColumn("confidence", F.lit(None).cast("double")) if confidence is None else out.join(confidence, "doc_id", "left")
    marks = flags(F.col("confidence"), F.col("text"), F.size("structure.sections"), F.size("structure.tables"), F.col("failed"))
    return out.select(F.col("doc_id").alias("filename"), category(F.col("doc_id")).alias("category"), path_taken(F.col("name"), F.col("native"), F.col("failed")).alias("path_taken"), F.when(~F.col("failed"), F.col("seconds")).alias("seconds"), F.when(~F.col("failed"), F.col("confidence")).alias("confidence"), marks.alias("flags"), "failed", "error")


def detail(rows: DataFrame) -> DataFrame:
    """The listing by category and file."""
    return rows.orderBy("category", "filename")

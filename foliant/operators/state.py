"""Pipeline state as an append-only log of events: current rows, stages, failures, fan-out and recent documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("QUEUED", "PROCESSING", "DONE", "FAILED")
EVENT = "doc_id string, seq long, status string, source string, raw_file_path string, extracted_text string, text_source string, ocr_lang string, searchable_pdf_key string, error_message string, at timestamp"
RECENT = 50


def current(events: DataFrame, late: tuple[str, ...] = ("searchable_pdf_key",)) -> DataFrame:
    """The last event of each document; the late columns hold the last value that isn't null, wherever it came.

    events may hold rows of snapshot(), in which a late column's value has the seq that it came with.
    """
    rows = snapshot(events, late)
    return rows.drop(*(f"{c}_seq" for c in late))


def snapshot(events: DataFrame, late: tuple[str, ...] = ("searchable_pdf_key",)) -> DataFrame:
    """current() with {column}_seq for each late column: one row stands for all events of a document, also beside later ones."""
    late = tuple(c for c in late if c in events.columns)
    came = {c: F.coalesce(F.col(f"{c}_seq"), F.col("seq")) if f"{c}_seq" in events.columns else F.col("seq") for c in late}
    last = F.max_by(F.struct(*(c for c in events.columns if c not in ("doc_id", *late, *(f"{c}_seq" for c in late)))), "seq")
    pairs = [F.max(F.when(F.col(c).isNotNull(), F.struct(came[c].alias("seq"), F.col(c).alias("value")))).alias(c) for c in late]
    rows = events.groupBy("doc_id").agg(last.alias("e"), *pairs)
    return rows.select("doc_id", "e.*", *(F.col(f"{c}.value").alias(c) for c in late), *(F.col(f"{c}.seq").alias(f"{c}_seq") for c in late))


def failure(stage: Column, kind: Column, message: Column, seconds: Column) -> Column:
    """The error message of a failed stage: structure, or extraction by timeout or otherwise; null for no failure."""
    number = F.regexp_replace(F.format_string("%.6f", seconds.cast("double")), r"\.?0+$", "")
    return (
        F.when(kind.isNull(), F.lit(None).cast("string")).when(stage == "structure", F.concat(F.lit("Structure parsing failed: "), message))
        .when(kind == "timeout", F.concat(F.lit("OCR service timed out after "), number, F.lit("s"))).otherwise(F.concat(F.lit("OCR extraction failed: "), message))
    )


def fan_out(extracted: DataFrame) -> DataFrame:
    """(doc_id, stage) of what follows each extraction (doc_id, text_source, error): structure always, a searchable PDF for scans; nothing after an error."""
    stages = F.when(F.coalesce(F.col("text_source") == "ocr", F.lit(False)), F.array(F.lit("structure"), F.lit("searchable_pdf"))).otherwise(F.array(F.lit("structure")))
    return extracted.where("error is null").select("doc_id", F.explode(stages).alias("stage"))


def recent(seen: DataFrame, live: DataFrame | None = None, most: int = RECENT) -> DataFrame:
    """(doc_id, seen_at) of the documents seen last, each once; of live (doc_id) ones only if given."""
    last = seen.groupBy("doc_id").agg(F.max("seen_at").alias("seen_at"))
    if live is not None:
        last = last.join(live.select("doc_id").distinct(), "doc_id", "left_semi")
    return last.orderBy(F.desc("seen_at"), "doc_id").limit(most)


def preview(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)

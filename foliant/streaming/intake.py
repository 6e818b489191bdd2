"""The pipeline on a stream of files: each batch is taken in, extracted, structured and appended to the event log.

An extraction is written once, and every later stage reads it from there. Stages are isolated: regions and searchable PDFs
that fail change nothing else, a structure that fails keeps the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.state import EVENT, failure, fan_out
from foliant.operators.structure import parse_structure
from foliant.sources.files import extract, intake
from foliant.sources.sinks import crops, store_crops, stored_regions

BINARY = "path string, modificationTime timestamp, length long, content binary"


def extracted(files: DataFrame, native: Callable | None, recognise: Callable, regions: Callable | None = None) -> DataFrame:
    """The accepted of files (path, length, content), with text, text_source, error, and regions and region_error if regions is given.

    regions, a column function of (name, content), gives a struct with an error beside its value; null content gives null.
    Rows of it are what the later stages need, so it is worth writing.
    """
    taken = intake(files).where("code = 202").select("doc_id", "source", F.col("key").alias("raw_file_path"), "name", "content")
    rows = extract(taken, native, recognise, keep=("source", "raw_file_path", "name", "content"))
    if regions:
        found = regions(F.col("name"), F.when(F.col("error").isNull(), F.col("content")))
        rows = rows.withColumn("_g", found).withColumn("regions", F.col("_g.regions")).withColumn("region_error", F.col("_g.error")).drop("_g")
    return rows.drop("content")


def region_crops(texts: DataFrame) -> DataFrame:
    """(doc_id, ord, …, data, storage_key) of the regions, array<struct<…,data:binary>>, of extracted() texts; a format of none is png."""
    rows = texts.select("doc_id", F.posexplode("regions").alias("ord", "r")).select("doc_id", "ord", "r.*")
    return crops(rows if "format" in rows.columns else rows.withColumn("format", F.lit("png")))


def outcomes(texts: DataFrame, structure_error: DataFrame | None = None, keys: DataFrame | None = None, lang: str | None = None, seconds: float = 240.0) -> DataFrame:
    """Events of extracted() texts, numbered for each document, so that the log can be replayed.

    0 QUEUED; 1 PROCESSING; 2 PROCESSING with the text, or FAILED; 3 DONE, or FAILED by structure_error (doc_id, message), the
    text kept; 4 the key of the searchable PDF, of keys (doc_id, searchable_pdf_key), where there is one. An error that
    starts with TimeoutError is one of the recogniser's time, after so many seconds.
    """
    late = F.col("error").startswith("TimeoutError")
    failed = failure(F.lit("extract"), F.when(late, "timeout").otherwise(F.when(F.col("error").isNotNull(), "error")), F.col("error"), F.lit(seconds))
    rows = texts.withColumn("failed", failed)
    none = lambda kind: F.lit(None).cast(kind)

    def event(rows: DataFrame, seq: int, status: Column, text: bool = True, error: Column | None = None, key: Column | None = None) -> DataFrame:
        of = lambda name: F.col(name) if text else none("string").alias(name)
        return rows.select(
            F.col("doc_id"), F.lit(seq).cast("long").alias("seq"), status.alias("status"), "source", "raw_file_path", of("text").alias("extracted_text"), of("text_source").alias("text_source"),
            (F.lit(lang).cast("string") if text else none("string")).alias("ocr_lang"), (none("string") if key is None else key).alias("searchable_pdf_key"), (none("string") if error is None else error).alias("error_message"), F.current_timestamp().alias("at"),
        )

    good = rows.where("failed is null")
    out = event(rows, 0, F.lit("QUEUED"), False).union(event(rows, 1, F.lit("PROCESSING"), False))
    out = out.union(event(rows, 2, F.when(F.col("failed").isNull(), "PROCESSING").otherwise("FAILED"), True, F.col("failed")))
    broken = good.withColumn("message", none("string")) if structure_error is None else good.join(structure_error.select("doc_id", "message"), "doc_id", "left")
    broken = broken.withColumn("broken", failure(F.lit("structure"), F.when(F.col("message").isNotNull(), "error"), F.col("message"), F.lit(0.0)))
    out = out.union(event(broken, 3, F.when(F.col("broken").isNull(), "DONE").otherwise("FAILED"), True, F.col("broken")))
    if keys is not None:
        made = broken.join(keys.where("searchable_pdf_key is not null").select("doc_id", "searchable_pdf_key"), "doc_id")
        out = out.union(event(made, 4, F.when(F.col("broken").isNull(), "DONE").otherwise("FAILED"), True, F.col("broken"), F.col("searchable_pdf_key")))
    return out


def faulty(rows: DataFrame, parse: Callable[[DataFrame], DataFrame], bit: int = 0) -> list[tuple]:
    """(doc_id, message) of the documents for which parse fails, found by halves: of n documents one takes some log n runs.

    parse is run over parts of rows until it works or is left with one document.
    """
    try:
        parse(rows).write.format("noop").mode("overwrite").save()
        return []
    except Exception as e:
        ids = [r[0] for r in rows.select("doc_id").distinct().limit(2).collect()]
        if len(ids) < 2 or bit > 62:
            return [(i, _reason(e)) for i in ids]
    half = F.pmod(F.shiftright(F.xxhash64("doc_id"), bit), F.lit(2))
    return [x for k in (0, 1) for x in faulty(rows.where(half == k), parse, bit + 1)]


def _reason(error: Exception) -> str:
    """The last line of what Python raised in a task, else the first of the message."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    raised = [x for x in lines if re.match(r"[A-Za-z_.]*(Error|Exception)\b.*: ", x)]
    return (raised or lines[:1] or [type(error).__name__])[-1]


def structured(texts: DataFrame, check: Callable[[Column], Column] | None = None, parse: Callable[[DataFrame], DataFrame] = parse_structure) -> tuple[DataFrame, DataFrame]:
    """Structures of what fan_out() sends to that stage, and (doc_id, message) of those that have none.

    These are the ones that check, a column function of the text, finds fault with, and those for which parse, a function of
    documents (doc_id, text, text_source), fails: the others get their structures all the same.
    """
    due = texts.join(fan_out(texts.select("doc_id", "text_source", "error")).where("stage = 'structure'").select("doc_id"), "doc_id", "left_semi")
    message = F.lit(None).cast("string") if check is None else check(F.col("text"))
    rows = due.withColumn("message", message)
    sound, broken = rows.where("message is null").select("doc_id", "text", "text_source"), rows.where("message is not null").select("doc_id", "message")
    if parse is not parse_structure and (found := faulty(sound, parse)):
        spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
        failed = spark.createDataFrame(found, f"doc_id {kind}, message string")
        sound, broken = sound.join(failed.select("doc_id"), "doc_id", "left_anti"), broken.union(failed)
    return parse(sound), broken


def searchable(texts: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, searchable_pdf_key, data, error) of what fan_out() sends to that stage; make gives (doc_id, data, error) of documents (doc_id, name, raw_file_path). No data, no key."""
    due = fan_out(texts.select("doc_id", "text_source", "error")).where("stage = 'searchable_pdf'").select("doc_id")
    made = make(texts.join(due, "doc_id", "left_semi").select("doc_id", "name", "raw_file_path"))
    key = F.when(F.length("data") > 0, F.concat(F.col("doc_id").cast("string"), F.lit("/searchable.pdf")))
    return made.select("doc_id", key.alias("searchable_pdf_key"), "data", "error")


def _fields(kind) -> list[str]:
    return getattr(getattr(kind, "elementType", None), "names", [])


def run_stream(
    spark: SparkSession, folder: str, log: str, structures: str, checkpoint: str, native: Callable | None, recognise: Callable, *, regions: Callable | None = None,
    check: Callable[[Column], Column] | None = None, make: Callable[[DataFrame], DataFrame] | None = None, lang: str | None = None, seconds: float = 240.0, every: str | None = None,
    parse: Callable[[DataFrame], DataFrame] = parse_structure,
):
    """Starts the query over files that arrive in folder; once for what is there, or as often as `every` says.

    Texts, with regions, go to `{log}-texts`, searchable PDFs to `{log}-pdfs`; crops that regions have as data to `{log}-crops`,
    each content once, and their metadata to `{log}-regions`. A batch overwrites its own part of each, so a repeated one adds
    nothing.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", 1000).load(folder)

    def batch(df: DataFrame, n: int) -> None:
        def save(rows: DataFrame, root: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{root}/batch={n}")
            return spark.read.schema(rows.schema).parquet(f"{root}/batch={n}")

        texts = save(extracted(df, native, recognise, regions), f"{log}-texts")
        if regions and "data" in _fields(texts.schema["regions"].dataType):
            found = region_crops(texts)
            store_crops(found.select("storage_key", "data"), f"{log}-crops", n)
            save(stored_regions(texts, found.drop("storage_key", "data")), f"{log}-regions")
        parsed, broken = structured(texts, check, parse)
        save(parsed, structures)
        keys = save(searchable(texts, make), f"{log}-pdfs").select("doc_id", "searchable_pdf_key") if make else None
        save(outcomes(texts, broken, keys, lang, seconds), log)

    stream = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(log)

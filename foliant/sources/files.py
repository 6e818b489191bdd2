"""Files as DataFrames: intake, keys, routing of PDFs and images, native text, recognisers, payloads and languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import default, strip

MOST_BYTES = 25 * 1024 * 1024
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
NATIVE_CHARS = 20
LANG = r"\A[a-z]{3}(\+[a-z]{3})*\z"
PSM = range(14)
IMAGE_JSON = "array<struct<bbox:array<double>,bbox_space:string,page:int,source:string,region_type_guess:string,width:int,height:int,format:string,image_base64:string>>"
PAYLOAD = f"text string, text_source string, tables array<array<array<string>>>, table_regions array<struct<bbox:array<int>,page:int,region_text:string,source:string>>, images {IMAGE_JSON}"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files under root with a known suffix, any case, in order of path; without their bytes, which contents() adds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("path").rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$")).select("path", "modificationTime", "length").orderBy("path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """The same files, unordered, with their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("path").rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$"))


def storage_key(doc_id: Column, name: Column) -> Column:
    base = F.element_at(F.split(default(name, "upload"), "/"), -1)
    return F.concat_ws("/", doc_id, default(base, "upload"))


def crop_key(doc_id: Column, n: Column, format_: Column) -> Column:
    return F.concat(doc_id, F.lit("/images/"), n.cast("string"), F.lit("."), default(F.ltrim(default(format_, "png"), F.lit(".")), "png"))


def inside_root(key: Column) -> Column:
    """Whether a relative key stays under its root: it isn't absolute, and no `..` leads above."""
    step = F.aggregate(
        F.split(key, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("depth"), F.least(a["least"], a["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least")),
        lambda a: a["least"],
    )
    return (step >= 0) & ~key.startswith("/")


def intake(files: DataFrame, source: str | Column = "unknown") -> DataFrame:
    """files (path, length, content) with doc_id, key, code and error: 400 empty, 413 too large, else 202 and status QUEUED."""
    code = F.when(F.col("length") == 0, 400).when(F.col("length") > MOST_BYTES, 413).otherwise(202)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("doc_id", F.sha2(F.concat_ws("|", "path", F.col("length").cast("string")), 256)).withColumn("code", code)
    error = F.when(F.col("code") == 400, "the file is empty").when(F.col("code") == 413, "the file is too large")
    label = default(F.trim(source if isinstance(source, Column) else F.lit(source)), "unknown")
    return rows.select("doc_id", label.alias("source"), name.alias("name"), storage_key(F.col("doc_id"), name).alias("key"), "code", error.alias("error"), F.when(F.col("code") == 202, "QUEUED").alias("status"), "content")


def is_pdf(name: Column, content: Column) -> Column:
    """By suffix or by the first four bytes."""
    return F.coalesce(F.lower(name).rlike(r"[^/]\.pdf\z"), F.lit(False)) | F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def native_text(pages: Column) -> Column:
    """Page texts joined by blank lines, each stripped, blank ones out; null if that is too short to be the document's text."""
    text = F.array_join(F.filter(F.transform(pages, strip), lambda x: x != ""), "\n\n")
    return F.when(F.length(text) >= NATIVE_CHARS, text)


def scanned_text(pages: Column) -> Column:
    return F.array_join(pages, "\n\n")


def _read(column: Column, kind) -> tuple[Column, Column]:
    """Page texts and error of what a column function gave: an array of texts, or a struct<pages,error> as isolated() makes."""
    if kind.simpleString().startswith("struct"):
        return column["pages"], column["error"]
    return column, F.lit(None).cast("string")


def extract(files: DataFrame, native: Callable | None, recognise: Callable, keep: tuple[str, ...] = ()) -> DataFrame:
    """files (doc_id, name, content) to doc_id, text, text_source and error, after the columns that keep names.

    native and recognise are column functions of (name, content) that give page texts, array<string>, or struct<pages,error>
    as recognisers.isolated() makes them. Each is planned once: a file that isn't one for it comes to it with null content,
    which is to give null. So native sees PDFs only, and recognise what has no native text. An error of native is no error of
    the file, which is then recognised; an empty file, and one of which nothing was recognised, is one.
    """
    rows = files.withColumn("_bad", F.coalesce(F.length("content"), F.lit(0)) == 0)
    if native:
        rows = rows.withColumn("_native", native(F.col("name"), F.when(~F.col("_bad") & is_pdf(F.col("name"), F.col("content")), F.col("content"))))
        pages, _ = _read(F.col("_native"), rows.schema["_native"].dataType)
        rows = rows.withColumn("_n", F.when(is_pdf(F.col("name"), F.col("content")), native_text(pages)))
    else:
        rows = rows.withColumn("_n", F.lit(None).cast("string"))
    rows = rows.withColumn("_read", recognise(F.col("name"), F.when(~F.col("_bad") & F.col("_n").isNull(), F.col("content"))))
    pages, error = _read(F.col("_read"), rows.schema["_read"].dataType)
    scanned = F.when(~F.col("_bad") & F.col("_n").isNull(), scanned_text(pages))
    rows = rows.withColumn("_scan", scanned).withColumn("_error", error)
    found = F.col("_n").isNotNull()
    problem = F.when(F.col("_bad"), F.lit("empty file")).when(~found, F.coalesce("_error", F.when(F.col("_scan").isNull(), F.lit("nothing was recognised"))))
    ok = problem.isNull()
    return rows.select("doc_id", *keep, F.when(ok, F.coalesce("_n", "_scan")).alias("text"), F.when(ok, F.when(found, "native_pdf").otherwise("ocr")).alias("text_source"), problem.alias("error"))


def payload(json: Column) -> Column:
    """A recogniser's answer as a struct: missing tables, regions and images are empty, the source of text is ocr by default.

    Images without valid bytes and regions without text are left out.
    """
    x = F.from_json(json, PAYLOAD)
    images = F.filter(F.transform(F.coalesce(x["images"], F.array().cast(IMAGE_JSON)), lambda i: i.withField("data", F.try_to_binary(i["image_base64"], F.lit("base64")))), lambda i: F.coalesce(F.length(i["data"]) > 0, F.lit(False)))
    regions = F.filter(F.coalesce(x["table_regions"], F.array().cast("array<struct<bbox:array<int>,page:int,region_text:string,source:string>>")), lambda r: F.coalesce(strip(r["region_text"]), F.lit("")) != "")
    return F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["text_source"], F.lit("ocr")).alias("text_source"), F.coalesce(x["tables"], F.array().cast("array<array<array<string>>>")).alias("tables"), regions.alias("table_regions"), images.alias("images"))


def lang_outcome(lang: Column, installed: list[str] | None) -> Column:
    """ok; `422` for a shape other than codes joined by +; else `400:` and the sorted codes that aren't installed.

    installed is what a probe of the recogniser gave; None, a probe that failed, leaves English alone.
    """
    have = F.array(*map(F.lit, ["eng"] if installed is None else installed)).cast("array<string>")
    missing = F.array_sort(F.array_distinct(F.array_except(F.split(lang, r"\+"), have)))
    return F.when(~F.coalesce(lang.rlike(LANG), F.lit(False)), "422").when(F.size(missing) > 0, F.concat(F.lit("400:"), F.array_join(missing, ","))).otherwise("ok")


def check_ocr(psm: int = 6, extract_images: bool = True) -> dict:
    """The recogniser's parameters; one out of range is an error."""
    if isinstance(psm, bool) or psm not in PSM:
        raise ValueError("psm must be 0 to 13")
    if not isinstance(extract_images, bool):
        raise ValueError("extract_images must be true or false")
    return {"psm": psm, "extract_images": extract_images}

"""Stored bytes as a keyed table, crops of image regions, projections of records, and report files."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.sources.files import crop_key, inside_root
from foliant.sources.shared import file_system

BLOB = "key string, data binary"
RECORD = ("doc_id", "source", "status", "raw_file_path", "extracted_text", "structured_data", "image_regions", "error_message", "created_at", "updated_at")
SUMMARY = ("doc_id", "source", "status", "created_at", "updated_at")


def write_blobs(blobs: DataFrame, root: str) -> None:
    """Appends (key, data); a key that leads out of the root is an error."""
    if not blobs.where(~F.coalesce(inside_root(F.col("key")), F.lit(False))).isEmpty():
        raise ValueError("a key leads out of the store")
    blobs.select("key", "data").write.mode("append").parquet(root)


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BLOB).parquet(root)


def write_keyed(rows: DataFrame, key: str, path: str, buckets: int) -> DataFrame:
    """rows as a table in path, bucketed and sorted by key, with bloom filters of it, so that lookup() reads one bucket's matching groups."""
    name = f"foliant_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path)
    dealt.option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(name)
    return rows.sparkSession.table(name)


def open_keyed(spark: SparkSession, schema: StructType, key: str, path: str, buckets: int) -> DataFrame:
    """A table that write_keyed() left in path, in another session."""
    name = f"foliant_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"create table {name} ({columns}) using parquet options (path '{path}') clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets")
    return spark.table(name)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key, none of a null one."""
    return table.where(F.col(key) == F.lit(value).cast(table.schema[key].dataType))


def crops(regions: DataFrame) -> DataFrame:
    """regions (doc_id, ord, bbox, bbox_space, page, source, region_type_guess, width, height, format, data) with storage_key."""
    return regions.withColumn("storage_key", crop_key(F.col("doc_id").cast("string"), F.col("ord"), F.col("format")))


def stored_regions(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, image_regions): metadata of each document's crops in order, without bytes; null, not empty, where there are none."""
    fields = ["storage_key", *(c for c in ("bbox", "bbox_space", "page", "source", "region_type_guess", "width", "height", "format") if c in regions.columns)]
    some = crops(regions).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("m")))).alias("l"))
    return docs.select("doc_id").join(some, "doc_id", "left").select("doc_id", F.transform("l", lambda x: x["m"]).alias("image_regions"))


def store_crops(crops: DataFrame, root: str, batch: int) -> None:
    """Stores crops (storage_key, data) of a batch: each content once, whatever batches and keys it comes with.

    A batch overwrites its own part, so a repeated one adds nothing. Contents of other batches are known by their digests.
    """
    spark = crops.sparkSession
    digest = F.sha2("data", 256)
    rows = crops.where("data is not null").select("storage_key", digest.alias("digest"), "data")
    known = _parts(spark, f"{root}/contents", batch)
    fresh = rows.groupBy("digest").agg(F.first("data").alias("data"))
    if known is not None:
        fresh = fresh.join(known.select("digest"), "digest", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{root}/contents/batch={batch}")
    rows.select("storage_key", "digest").distinct().write.mode("overwrite").parquet(f"{root}/keys/batch={batch}")


def _parts(spark: SparkSession, folder: str, but: int) -> DataFrame | None:
    """The parts of a folder that other batches wrote."""
    fs, p = file_system(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    others = [x.toString() for x in parts if x.getName().startswith("batch=") and x.getName() != f"batch={but}"]
    return spark.read.parquet(*others) if others else None


def read_crops(spark: SparkSession, root: str) -> DataFrame:
    """(key, data) of store_crops(), of a key that came again what it was given last; for resolved()."""
    last = spark.read.parquet(f"{root}/keys").groupBy("storage_key").agg(F.max_by("digest", "batch").alias("digest"))
    return last.join(spark.read.parquet(f"{root}/contents").drop("batch"), "digest").select(F.col("storage_key").alias("key"), "data")


def resolved(regions: DataFrame, blobs: DataFrame) -> DataFrame:
    """regions (storage_key, …) with data, null where the store lacks the key; the same key stored twice counts once."""
    once = blobs.groupBy("key").agg(F.first("data").alias("data"))
    return regions.join(once.withColumnRenamed("key", "storage_key"), "storage_key", "left")


def record(documents: DataFrame) -> DataFrame:
    """The full record: what a lookup returns; internal columns are left out."""
    return documents.select(*(c for c in RECORD if c in documents.columns))


def summary(hits: DataFrame) -> DataFrame:
    """The search result: summary columns, rank and snippet."""
    return hits.select(*(c for c in (*SUMMARY, "rank", "snippet") if c in hits.columns))


def check_report_path(path: str, repository: str, allowed: str = "reports") -> str:
    """The normalised path; one inside the repository but outside its reports folder is an error."""
    path, repository = posixpath.normpath(path), posixpath.normpath(repository)
    inside = lambda root: path == root or path.startswith(root + "/")
    if inside(repository) and not inside(posixpath.join(repository, allowed)):
        raise ValueError("reports must not be written into the repository")
    return path


def check_samples_path(path: str, repository: str) -> str:
    path, repository = posixpath.normpath(path), posixpath.normpath(repository)
    if path == repository or path.startswith(repository + "/"):
        raise ValueError("samples must not lie in the repository")
    return path


def write_report(lines: DataFrame, path: str | None, repository: str) -> None:
    """Writes the report's lines (line, in their order) as one text file's folder, or to standard output if there is no path.

    A report has a line for each category, so one task writes it.
    """
    if path is None:
        for row in lines.select("line").toLocalIterator():
            print(row["line"])
    else:
        lines.select("line").coalesce(1).write.mode("overwrite").text(check_report_path(path, repository))

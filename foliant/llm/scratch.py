"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: With it set, an SQL execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What scratch tables are written with: that, and Arrow batches of some MB, so that long texts don't make large ones.
SETTINGS = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a temporary folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="foliant-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Scratch folders that are not closed yet.
_open: list[Scratch] = []


@contextlib.contextmanager
def temporary():
    """Closes on leaving what was opened inside; what is to stay must have been written elsewhere by then."""
    before = list(_open)
    try:
        yield
    finally:
        for s in [s for s in _open if s not in before]:
            s.close()


@atexit.register
def _close_all() -> None:
    for s in list(_open):
        with contextlib.suppress(Exception):  # the session may be gone
            s.close()


class Scratch:
    """Named Parquet tables under one fresh folder; writing one cuts its lineage.

    The tables live as long as the session needs the returned DataFrames. drop() removes one that nothing reads any more,
    close() removes all of them; temporary() does so for what is opened inside it, and the end of the program for the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{base_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
        self._n = 0
        _open.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, *parts: str, **metrics: Column) -> DataFrame:
        """df as a Parquet table, in folders by the columns parts, which must be its last ones.

        Its rows are counted as they are written, so are aggregates named in metrics; see counted().
        """
        path, seen = self.path(name), Observation()
        with self.clean():
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())).write.partitionBy(*parts).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path, out._scratch_seen = path, _seen(seen) or out.agg(F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())).first().asDict()
        return out

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """df as a table bucketed and sorted by key, so that a plan which needs its rows by key finds them in place."""
        path, table = self.path(name), f"foliant_{uuid.uuid4().hex}"
        with self.clean():
            df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path, out._scratch_table = path, table
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if name := getattr(t, "_scratch_table", None):
                self.spark.sql(f"drop table if exists {name}")
            if p := getattr(t, "_scratch_path", None):
                self._delete(p)

    def drop_part(self, table: DataFrame, part: str) -> None:
        """Removes the folder part, column=value, of a table that is in folders by that column."""
        self._delete(f"{table._scratch_path}/{part}")

    @contextlib.contextmanager
    def clean(self):
        """Executions begun here have SETTINGS, so they remove their shuffle files when they end, also when they fail."""
        before = {k: self.spark.conf.get(k, None) for k in SETTINGS}
        try:
            for k, v in SETTINGS.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _seen(observation: Observation, tries: int = 50) -> dict | None:
    """What an observation has seen; it comes shortly after the write, or not at all if the plan turned out empty."""
    for _ in range(tries):
        if got := observation._jo.getOrEmpty():
            if got.nonEmpty():
                return dict(observation.get)
    return None


def counted(df: DataFrame) -> dict | None:
    """What was counted when df, a scratch table, was written; None of other tables."""
    return getattr(df, "_scratch_seen", None)


def small_or_shuffled(df: DataFrame, rows: int, of: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else unchanged, so that a shuffle join runs.

    The rows of a scratch table are known, also if it is `of`, of which df is a part; another table is counted here.
    """
    seen = counted(df if of is None else of)
    small = seen["rows"] <= rows if seen else df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def is_empty(df: DataFrame) -> bool:
    seen = counted(df)
    return not seen["rows"] if seen else df.isEmpty()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Current rows kept as a log of events streams in, by state for each document; and logs made shorter.

An event costs a look at its document's state, however long the log is. What a batch changed is written once; the newest row of
a document is its current one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from foliant.operators.state import snapshot
from foliant.sources.shared import file_system

#: The store that state by key needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _kept(schema: StructType, late: tuple[str, ...]) -> StructType:
    fields = [f for f in schema if f.name not in ("doc_id", *late)] + [schema[c] for c in late] + [StructField(f"{c}_seq", schema["seq"].dataType) for c in late]
    return StructType([StructField(f.name, f.dataType, True) for f in fields])


class Current(StatefulProcessor):
    """Of each document the event of greatest seq, and of each late column the value that isn't null of greatest seq."""

    def __init__(self, schema: StructType, late: tuple[str, ...]):
        self.kept, self.late = _kept(schema, late), late
        self.plain = [f.name for f in self.kept if f.name not in (*late, *(f"{c}_seq" for c in late))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("current", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.kept.names
        now = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names)
        for row in rows:
            if now["seq"] is None or row["seq"] > now["seq"]:
                now |= {c: row[c] for c in self.plain}
            for c in self.late:
                if row[c] is not None and (now[f"{c}_seq"] is None or row["seq"] > now[f"{c}_seq"]):
                    now[c], now[f"{c}_seq"] = row[c], row["seq"]
        self.state.update(tuple(now[c] for c in names))
        yield Row(doc_id=key[0], **{c: now[c] for c in names})

    def close(self) -> None:
        pass


def keep_current(events: DataFrame, root: str, checkpoint: str, late: tuple[str, ...] = ("searchable_pdf_key",), every: str | None = None):
    """Starts the query that keeps the current rows of a stream of events (doc_id, seq, …) in root.

    Events may come in any order and more than once. A batch writes the rows that it changed over its own part, so a repeated
    one changes nothing.
    """
    spark = events.sparkSession
    late = tuple(c for c in late if c in events.columns)
    out = StructType([events.schema["doc_id"], *_kept(events.schema, late)])
    changed = events.groupBy("doc_id").transformWithState(Current(events.schema, late), out, "Update", "None")

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/batch={n}")

    stream = changed.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:  # a query keeps the settings that it was started with
        return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def current_rows(spark: SparkSession, root: str, late: tuple[str, ...] = ("searchable_pdf_key",)) -> DataFrame:
    """The current rows that keep_current() left in root: of each document those of its last change."""
    rows = spark.read.parquet(root)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("doc_id", "batch"))), "batch").alias("r"))
    return last.select("doc_id", "r.*").drop(*(f"{c}_seq" for c in late))


def compact_log(spark: SparkSession, log: str, upto: int, late: tuple[str, ...] = ("searchable_pdf_key",)) -> None:
    """Puts one row for each document in place of the log's batches up to a number: state.current() of the log stays what it was.

    The new part is there before the old ones go, and rows that are in both change nothing, so this can stop and be repeated at
    any point. The last batch of a stream that runs may be written again and must not be among them.
    """
    fs, p = file_system(spark, log)
    parts = {s.getPath().getName(): s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")}
    number = lambda name: int(name.removeprefix("batch=").removeprefix("upto-"))
    old = {name: path for name, path in parts.items() if number(name) <= upto}
    new = f"batch=upto-{upto}"
    if not old or set(old) == {new}:
        return
    # folders without snapshots lack the columns of their seqs
    events = spark.read.option("mergeSchema", "true").parquet(*(path.toString() for path in old.values()))
    snapshot(events, late).write.mode("ignore" if new in old else "errorifexists").parquet(f"{log}/{new}")
    for name, path in old.items():
        if name != new:
            fs.delete(path, True)

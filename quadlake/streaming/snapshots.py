"""Incremental snapshot jobs over landed files.

Every job is a file-source stream with `foreachBatch`. State lies in folders by partition (a
bucket of keys, a day) and version (the batch that wrote it). A batch reads and rewrites only the
partitions its rows fall into, so its work grows with the batch, not with what is stored. A batch that
runs again after a lost executor or driver overwrites its own version and leaves the same state.
Tables and the stream checkpoint live in the shared folder the caller names.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from quadlake.operators.temporal import daily_first
from quadlake.operators.upsert import last_wins
from quadlake.sources.sinks import child_folders, delete_folder, work_folder

#: Buckets of keys; versions of a partition that are kept for readers of earlier batches.
BUCKETS = 64
GRACE = 3

shared_folder = work_folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run."""
    return posixpath.join(work_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _start(source: DataFrame, root: str, on_batch: Callable[[DataFrame, int], None],
           available_now: bool) -> StreamingQuery:
    def held(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            on_batch(df, batch)
        finally:
            df.unpersist()

    writer = source.writeStream.foreachBatch(held).option(
        "checkpointLocation", posixpath.join(root, "_checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None,
           pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


# ---- partitions and versions ----------------------------------------------------------------

def _version(folder: str) -> int:
    return int(folder.rsplit("v=", 1)[1])


def latest_folders(spark: SparkSession, path: str, partitions: Iterable[str], before: int) -> list[str]:
    """For each partition folder its newest version from before a batch. Partitions without one are left out."""
    found = []
    for partition in partitions:
        versions = [v for v in child_folders(spark, posixpath.join(path, partition)) if v.startswith("v=") and _version(v) < before]
        if versions:
            found.append(posixpath.join(path, partition, max(versions, key=_version)))
    return found


def read_folders(spark: SparkSession, path: str, folders: Sequence[str], schema: StructType, *drop: str) -> DataFrame:
    """Only the named folders of a partitioned table: nothing else is listed or read."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop(*drop)


def _touched(df: DataFrame, column: str) -> list[str]:
    """Partition folders the rows of a batch fall into."""
    values = [r[0] for r in df.select(column).distinct().collect()]
    return sorted(f"{column}={v}" for v in values if v is not None)


def _write(df: DataFrame, path: str, column: str, batch: int) -> None:
    (df.withColumn("v", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column, "v").parquet(path))


def _forget(spark: SparkSession, path: str, partitions: Iterable[str], batch: int) -> None:
    """Delete versions of touched partitions that no reader of the last batches can need."""
    for partition in partitions:
        folder = posixpath.join(path, partition)
        versions = sorted((v for v in child_folders(spark, folder) if v.startswith("v=")), key=_version)
        old = [v for v in versions if _version(v) <= batch - GRACE]
        for v in old[:-1]:
            delete_folder(spark, posixpath.join(folder, v))


def _append_new(batch_df: DataFrame, root: str, name: str, batch: int, keys: Sequence[str], ts: str) -> None:
    """Append rows whose keys are not stored yet, by day and batch.

    Only the days present in the batch are read back, by their folders, and the batch's own folder from an
    earlier attempt is ignored. Rows without a time have no day to look in and are all kept.
    """
    spark = batch_df.sparkSession
    path = posixpath.join(root, name)
    dated = batch_df.withColumn("day", F.col(ts).cast("date"))
    folders = [posixpath.join(path, day, v) for day in _touched(dated, "day")
               for v in child_folders(spark, posixpath.join(path, day)) if _version(v) < batch]
    stored = read_folders(spark, path, folders, batch_df.schema, "v").select(*keys)
    _write(dated.join(stored, list(keys), "left_anti"), path, "day", batch)


# ---- jobs -----------------------------------------------------------------------------------

def start_latest(source: DataFrame, root: str, key: str, ts: str, tie: str,
                 available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Latest row per key (table `current`, by buckets of keys) and history without repeated (key, ts)."""
    schema, path = source.schema, posixpath.join(root, "current")

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        placed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = _touched(placed, "bucket")
        before = read_folders(spark, path, latest_folders(spark, path, touched, batch), schema, "v", "bucket")
        merged = last_wins(before.unionByName(df), [key], [ts, tie])
        _write(merged.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), path, "bucket", batch)
        _forget(spark, path, touched, batch)
        _append_new(last_wins(df, [key, ts], [tie]), root, "history", batch, [key, ts], ts)

    return _start(source, root, on_batch, available_now)


def start_daily_first(source: DataFrame, root: str, key: str, ts: str, tie: str,
                      available_now: bool = True) -> StreamingQuery:
    """One snapshot per key and day: the first that arrives stays."""
    def on_batch(df: DataFrame, batch: int) -> None:
        first = daily_first(df, key, ts, tie).withColumn("snapshot_day", F.col(ts).cast("date"))
        _append_new(first, root, "daily", batch, [key, "snapshot_day"], ts)

    return _start(source, root, on_batch, available_now)


def start_slots(source: DataFrame, root: str, clock: Callable[[], dt.datetime] = dt.datetime.now,
                available_now: bool = True) -> StreamingQuery:
    """Slot table kept up to date: known slots updated, ended slots removed.

    The clock is asked in every batch. Slots lie by the day they end: a batch rewrites the days it holds slots of, and
    days that are over are dropped as folders, unread. Slots of today that have ended since are left out by `slots_table`.
    """
    from quadlake.plans.rooms import refresh_slots

    schema, path = source.schema, posixpath.join(root, "slots")
    keys = ["room", "starts", "ends"]

    def on_batch(df: DataFrame, batch: int) -> None:
        spark, now = df.sparkSession, clock()
        as_of = now.strftime("%Y-%m-%d %H:%M:%S.%f")
        incoming = (last_wins(df, keys, keys).where(F.col("ends") >= F.lit(as_of).cast("timestamp_ntz"))
                    .withColumn("end_day", F.col("ends").cast("date")))
        touched = _touched(incoming, "end_day")
        before = read_folders(spark, path, latest_folders(spark, path, touched, batch), schema, "v", "end_day")
        kept = refresh_slots(before, incoming.drop("end_day"), as_of)
        _write(kept.withColumn("end_day", F.col("ends").cast("date")), path, "end_day", batch)
        _forget(spark, path, touched, batch)
        for day in child_folders(spark, path):
            if day.startswith("end_day=") and day.removeprefix("end_day=") < now.strftime("%Y-%m-%d"):
                delete_folder(spark, posixpath.join(path, day))

    return _start(source, root, on_batch, available_now)


# ---- readers --------------------------------------------------------------------------------

def current_table(spark: SparkSession, root: str, name: str, batch: int) -> DataFrame:
    """The table as the given batch, one of the last `GRACE`, left it: the newest version of each partition up to it."""
    path = posixpath.join(root, name)
    partitions = [p for p in child_folders(spark, path) if "=" in p]
    folders = latest_folders(spark, path, partitions, batch + 1)
    if not folders:
        raise ValueError(f"no batch up to {batch} left a table at {path}")
    column = partitions[0].split("=", 1)[0]
    return spark.read.option("basePath", path).parquet(*folders).drop("v", column)


def slots_table(spark: SparkSession, root: str, batch: int, as_of: dt.datetime) -> DataFrame:
    """Slots that have not ended."""
    return current_table(spark, root, "slots", batch).where(F.col("ends") >= F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz"))


def last_batch(query: StreamingQuery) -> int:
    """Id of the last batch a finished stream ran."""
    progress = query.lastProgress
    if progress is None:
        raise ValueError("the stream ran no batch")
    return int(progress["batchId"])


def history_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(root, name)).drop("v", "day")

"""Writing table versions.

Parquet has no multi-table transaction: every version goes to its own folder and
the catalogue's table is then moved to it, dimensions before facts.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_work")).rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> DataFrame:
    """A table written to the work folder and read back, for results that several steps read."""
    path = posixpath.join(work_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is missing."""
    where, system = _file_system(spark, path)
    if not system.exists(where):
        return []
    return sorted(x.getPath().getName() for x in system.listStatus(where) if x.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    where, system = _file_system(spark, posixpath.join(path, "_SUCCESS"))
    return system.exists(where)


def fingerprint(table: DataFrame) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of a table's files: another one once any of them changes."""
    out = []
    for path in sorted(table.inputFiles()):
        where, system = _file_system(table.sparkSession, path)
        status = system.getFileStatus(where)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def replace_all(new: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full replacement of a table's files (all partitions, whatever the session says)."""
    writer = new.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_partitions(new: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Rewrite only the partitions present in `new`."""
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Facts laid out by join key: joins and aggregations on the keys need no exchange.

    Give all tables that join on the keys the same number of buckets, sized so that one
    bucket fits a task.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def publish(df: DataFrame, root: str, name: str, version: str, keep: int = 2) -> str:
    """Write one version of a table and move the catalogue table `name` to it.

    The table is one of the session's catalogue, so every session that shares it reads what was published. Readers
    see the old version until the new one is complete, and the job may read the very table it replaces: a job that stops
    half-way leaves the table where it was, and can be repeated. Each run takes a version of its own; the last `keep` by
    time are left on storage for readers that began before. A session that has read the table remembers its files until it
    refreshes it (`spark.catalog.refreshTable`), as with any table. New columns make a new table of that name.
    """
    spark = df.sparkSession
    path = posixpath.join(root, name, f"v={version}")
    df.write.mode("overwrite").parquet(path)
    moved = spark.catalog.tableExists(name) and spark.table(name).schema == spark.read.parquet(path).schema
    where = path.replace("'", "\\'")
    if moved:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{where}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{where}'")
    spark.catalog.refreshTable(name)
    _retire_versions(spark, posixpath.join(root, name), path, keep)
    return path


def _retire_versions(spark: SparkSession, folder: str, current: str, keep: int) -> None:
    """Delete complete versions but the current one and the newest before it."""
    def time(path: str) -> int:
        where, system = _file_system(spark, path)
        return system.getFileStatus(where).getModificationTime()

    versions = [posixpath.join(folder, v) for v in child_folders(spark, folder) if v.startswith("v=")]
    others = sorted((v for v in versions if v != current and is_complete(spark, v)), key=time, reverse=True)
    for old in others[max(keep - 1, 0):]:
        delete_folder(spark, old)


def publish_all(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str) -> dict[str, str]:
    """Publish tables in the given order (dimensions first): a fact never names a row its dimension lacks."""
    return {name: publish(df, root, name, version) for name, df in tables.items()}


def refresh_view(build: Callable[[], DataFrame], root: str, name: str, version: str) -> str:
    """Recompute a materialised view and publish it."""
    return publish(build(), root, name, version)

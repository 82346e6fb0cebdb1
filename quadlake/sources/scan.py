"""Table scans with a declared schema, so no file is read for inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadlake.sources import schemas


def scan(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows in as many tasks as the session shuffles, for work that far outweighs the bytes it reads.

    A small file is read by one task, and tasks are merged by bytes alone; both leave cores idle here. With `keys`, rows
    alike in them come together; without, rows are dealt evenly whatever they hold.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Tables:
    """The supplied tables under one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            ddl = schemas.ddl(name)
        except KeyError:
            raise AttributeError(name) from None
        df = scan(self.spark, f"{self.folder}/{name}.parquet", ddl)
        setattr(self, name, df)
        return df


def question_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """Tables for the question functions, one folder each under `root`."""
    return {name: scan(spark, f"{root.rstrip('/')}/{name}", schemas.QUESTIONS[name])
            for name in names or schemas.QUESTIONS}

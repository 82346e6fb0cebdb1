"""Table maintenance as joins of the stored and the incoming rows.

Each returns the new version of the table; `sources.sinks.publish` writes it.
Incoming rows are unique per key (see `last_wins`), so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the last in the given order."""
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*"))


def merge_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str],
                   keep_old: Sequence[str] = ()) -> DataFrame:
    """Upsert in which a null never overwrites.

    Columns in `keep_old` (defaults, flags set by another job) keep their stored
    value for known keys and take the incoming value only for new ones.
    """
    keys = list(keys)
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_n"))
    joined = o.join(n, keys, "full_outer")

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o.{c}")
        if c in keep_old:
            return F.when(F.col("_o").isNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
        return F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}"))

    return joined.select(*keys, *[merged(c).alias(c) for c in old.columns if c not in keys])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows stay; incoming rows join only under new keys."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of touched parents are deleted, then the incoming rows come in."""
    kept = old.join(touched.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new)


def orphan_sweep(parent: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Only parents something still points to."""
    return parent.join(refs.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def retention_trim(df: DataFrame, ts: str, as_of: str, months: int = 15,
                   day: str | None = None) -> DataFrame:
    """Rows not older than the retention period; a plain range filter on the scan.

    With `day`, a date partition column, whole expired partitions are not even read.
    """
    cutoff = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(months)} MONTHS")
    kept = df.where(F.col(ts) >= cutoff)
    return kept if day is None else kept.where(F.col(day) >= cutoff.cast("date"))


def flag_reset_set(df: DataFrame, hits: DataFrame, keys: Sequence[str], flags: Mapping[str, str],
                   ok: Sequence[str]) -> DataFrame:
    """Refresh flags from (keys, category) hits.

    Categories in `ok` were fetched: their flag becomes "was hit". Others failed and
    keep what is stored.
    """
    per_key = hits.where(F.col("category").isin(list(ok))).groupBy(*keys).agg(*[
        F.bool_or(F.col("category") == code).alias(f"_{col}") for code, col in flags.items()])
    joined = df.join(per_key, list(keys), "left")
    refreshed = {
        flags[code]: F.coalesce(F.col(f"_{flags[code]}"), F.lit(False)) for code in ok}
    return joined.withColumns(refreshed).select(*df.columns)

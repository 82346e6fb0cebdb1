"""Aggregations: distributions, facets, bounded lists, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.operators.slices import paged_lists


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order; an aggregate, so copies combine map-side."""
    key = list(key)
    return (df.groupBy(*key)
            .agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
            .select("_r.*"))


def _sums(counts: Sequence[str], avg: str) -> list[Column]:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts]
    return [*sums, F.avg(avg).alias(avg)]


def dist_total(sections: DataFrame, counts: Sequence[str], avg: str,
               member_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Summed counts and the plain mean of section means, plus the sections themselves.

    `sections` holds one row per section; without rows the sums are 0, the mean null.
    """
    return sections.agg(*_sums(counts, avg)), sections.select(*member_cols)


def dist_by(sections: DataFrame, by: Sequence[str], counts: Sequence[str], avg: str,
            bridge: DataFrame | None = None, key: Sequence[str] = (),
            compat_fanout: bool = False, staffed_only: bool = False) -> DataFrame:
    """Distribution per group.

    With a bridge (section to instructor) every section counts once, also one without an
    instructor; `staffed_only` keeps those in the bridge, for a bridge that was filtered. With
    `compat_fanout` a section counts once per bridge row, as the older service did.
    """
    base = sections
    if bridge is not None:
        if compat_fanout:
            base = sections.join(bridge, list(key), "left")
        elif staffed_only:
            base = sections.join(bridge.select(*key).distinct(), list(key), "left_semi")
    return base.groupBy(*by).agg(*_sums(counts, avg))


def with_default(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def facet_options(base: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Distinct (facet, value) pairs of all facets in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return (base.select(F.explode(pairs).alias("p")).select("p.*")
            .where(F.col("value").isNotNull()).distinct())


def sorted_array_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sorted, null-free distinct values per group, for values from a small fixed domain."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.array_sort(F.collect_set(value)).alias(name)))


def distinct_array_by(df: DataFrame, keys: Sequence[str], value: str, slice_by: Column | None,
                      name: str, page_size: int = 1000) -> DataFrame:
    """Distinct null-free values per group in pages, for value domains of any size."""
    values = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return paged_lists(values, keys, [value], slice_by, F.col(value), name, page_size)


def nest(parent: DataFrame, child: DataFrame, key: str, order: Sequence, slice_by: Column | None,
         item: Column, name: str, page_size: int = 1000) -> DataFrame:
    """Parents with ordered child lists, one row per page; no child gives one empty page."""
    pages = paged_lists(child, [key], order, slice_by, item, name, page_size)
    joined = parent.join(pages, key, "left")
    empty = F.array().cast(pages.schema[name].dataType)
    return (joined.withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
            .withColumn(name, F.coalesce(F.col(name), empty)))


def nest_levels(levels: DataFrame, path: Sequence[str], order: Sequence, slice_by: Column,
                item: Column, name: str, page_size: int = 1000) -> DataFrame:
    """Flattened hierarchy to one row per (path, page) with the leaves as an ordered list.

    Upper levels stay columns: a list of everything under one school has no bound.
    """
    return paged_lists(levels, path, order, slice_by, item, name, page_size)


def nest_map(df: DataFrame, outer: str, inner: str, value: str, slice_by: Column,
             name: str, page_size: int = 1000) -> DataFrame:
    """Per outer key and page: map inner key -> ordered distinct values.

    Inner keys come from a small dimension; the values are what may grow.
    """
    pages = distinct_array_by(df, [outer, inner], value, slice_by, "_values", page_size)
    entry = F.struct(F.col(inner), F.col("_values"))
    return pages.groupBy(outer, "page").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def date_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("earliest"), F.max(col).alias("latest"))


def flag_counts(df: DataFrame, flags: Mapping[str, str], name: str) -> DataFrame:
    """(category, count of set flags) in one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(col)).alias(label) for label, col in flags.items()])
    pairs = F.array(*[
        F.struct(F.lit(label).alias("category"), F.col(f"`{label}`").alias(name)) for label in flags])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")


def reconcile(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched against stored counts and how many are missing."""
    joined = fetched.join(stored, "category", "full_outer")
    both = joined.select(
        "category", F.coalesce("fetched", F.lit(0)).alias("fetched"),
        F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.withColumn("missing", F.greatest(F.col("fetched") - F.col("stored"), F.lit(0)))


def history_vectors(df: DataFrame, key: str, day: str, metrics: Sequence[str]) -> DataFrame:
    """Parallel date and metric lists per key and year, in date order, nulls as "".

    Expects one row per key and day, so a list holds at most 366 entries.
    """
    point = F.struct(F.col(day).alias("d"), *[
        F.coalesce(F.col(m).cast("string"), F.lit("")).alias(m) for m in metrics])
    series = (df.groupBy(key, F.year(day).alias("history_year"))
              .agg(F.array_sort(F.collect_list(point)).alias("_s")))

    def metric(name: str) -> Column:
        return F.transform("_s", lambda p: p[name]).alias(name)

    return series.select(
        key, "history_year",
        F.transform("_s", lambda p: F.date_format(p["d"], "yyyy-MM-dd")).alias("dates"),
        *[metric(m) for m in metrics])


def group_intersection(sections: DataFrame, bridge: DataFrame, section: str, course: str,
                       number: str, value: str) -> DataFrame:
    """Instructors shared by all sections of a section group, else the section's own.

    Sections belong together when their numbers carry the same letters; a section
    without letters stands for the whole course. Each section brings its people and one
    mark: a person named as often as there are marks is shared. People are rows, not lists, which
    sorts hold in little memory; counts combine before they move and nothing of a course is listed whole.
    Without anybody in the bridge a section gives no row of its own; null people are people.
    """
    letters = F.upper(F.regexp_extract(F.col(number), "[A-Za-z]+", 0))
    staffed = bridge.select(section, F.col(value).alias("_who")).distinct().withColumn(
        "_at", F.row_number().over(Window.partitionBy(section).orderBy("_who")))
    # One row for each person of a section, or for a section of nobody (0); the first carries the mark.
    base = (sections.select(section, course, letters.alias("_group")).join(staffed, section, "left")
            .withColumn("_at", F.coalesce("_at", F.lit(0))))
    # A lettered section counts in its own group and in the whole course ('').
    member = F.when(F.col("_group") == "", F.array(F.lit(""))).otherwise(
        F.array(F.col("_group"), F.lit("")))
    counted = (base.select(course, "_who", "_at", F.explode(member).alias("_group"))
               .groupBy(course, "_group", "_who").agg(F.count_if(F.col("_at") > 0).alias("_n"), F.count_if(F.col("_at") <= 1).alias("_m")))
    marks = F.sum("_m").over(Window.partitionBy(course, "_group"))
    shared = (counted.withColumn("_marks", marks).where(F.col("_n") == F.col("_marks"))
              .groupBy(course, "_group").agg(F.collect_list(F.struct(F.col("_who").alias("v"))).alias("_shared")))
    own = F.when(F.col("_at") > 0, F.array(F.struct(F.col("_who").alias("v"))))
    return (base.join(shared, [course, "_group"], "left")
            .select(section, F.explode(F.when(F.col("_shared").isNull(), own).when(F.col("_at") <= 1, F.col("_shared"))).alias("_who"))
            .select(section, F.col("_who.v").alias(value)))


def merge_duplicates(df: DataFrame, keys: Sequence[str], array_col: str, pos: str,
                     page_size: int = 1000, width: int = 4096) -> DataFrame:
    """Rows with equal keys become one, their lists joined in row order (paged)."""
    items = df.select(*keys, pos, F.posexplode(array_col).alias("_i", "_v"))
    first = df.groupBy(*keys).agg(F.min(pos).alias("first_pos"))
    merged = paged_lists(items, keys, [pos, "_i"], F.floor(F.col(pos) / width), F.col("_v"),
                         array_col, page_size)
    return merged.join(first, list(keys), "inner")


def reset_childless(parent: DataFrame, child: DataFrame, key: str, flag: str) -> DataFrame:
    """The flag goes to false where the parent has no child."""
    has_child = child.select(key).distinct().withColumn("_child", F.lit(True))
    return (parent.join(has_child, key, "left")
            .withColumn(flag, F.col(flag) & F.col("_child").isNotNull()).drop("_child"))

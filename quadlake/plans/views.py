"""The two materialised views: courses with their people, people with their courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.operators.slices import paged_lists


def taught_pairs(taught: DataFrame) -> DataFrame:
    """Terms per (course, person). Terms are a few per year, so the list stays short."""
    return (taught.groupBy("course_key", "person_key")
            .agg(F.array_sort(F.collect_set("term")).alias("terms")))


def _paged(parent: DataFrame, pages: DataFrame, key: str, name: str) -> DataFrame:
    empty = F.array().cast(pages.schema[name].dataType)
    return (parent.join(pages, key, "left")
            .withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
            .withColumn(name, F.coalesce(F.col(name), empty)))


def course_view(courses: DataFrame, people: DataFrame, taught: DataFrame, shown: Column,
                page_size: int = 1000) -> DataFrame:
    """Courses with their terms and pages of instructors."""
    # Partial aggregation collapses the lines of a hot course to its distinct terms map-side.
    terms = taught.groupBy("course_key").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    staffed = (taught.where(shown).select("course_key", "person_key").distinct()
               .join(people, "person_key"))
    pages = paged_lists(staffed, ["course_key"], ["person_key"], None, F.struct("person_key", "name"), "instructors", page_size)
    return (_paged(courses, pages, "course_key", "instructors").join(terms, "course_key", "left")
            .withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))))


def person_view(courses: DataFrame, people: DataFrame, taught: DataFrame, shown: Column,
                page_size: int = 1000) -> DataFrame:
    """People with pages of the courses they taught and the terms they did."""
    pairs = taught_pairs(taught.where(shown)).join(courses, "course_key")
    pages = paged_lists(pairs, ["person_key"], ["course_key"], None, F.struct("course_key", "title", "terms"), "courses", page_size)
    return _paged(people.where(shown), pages, "person_key", "courses")

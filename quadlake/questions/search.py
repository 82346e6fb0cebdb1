"""Search over courses and people: the indexes, and the one question asked of both.

Tables and the columns read are those of `course_view`, `person_view` and `department`.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions import filters as flt
from quadlake.functions import fixed
from quadlake.functions.project import label
from quadlake.operators import search as srch
from quadlake.operators.diff import union_tagged
from quadlake.questions.offerings import CATEGORIES

Tables = Mapping[str, DataFrame]


def course_fields() -> dict[str, list]:
    """Id first, then what names the department and the number, the title, the description."""
    return {"A": ["course_id"],
            "B": ["department", label("department", fixed.DEPARTMENT_ALIASES), F.replace("department", F.lit(" "), F.lit("")), "course_number", F.col("course_numeric").cast("string")],
            "C": ["title"], "D": ["description"]}


PERSON_FIELDS = {"A": ["person_id"], "B": ["name", "title"]}


def write_indexes(tables: Tables, root: str) -> None:
    """Store the indexes of courses and people under `root`."""
    srch.write_index(tables["course_view"], posixpath.join(root, "course"), "course_id", course_fields())
    srch.write_index(tables["person_view"], posixpath.join(root, "person"), "person_id", PERSON_FIELDS)


def indexes(spark: SparkSession, root: str) -> dict[str, srch.Index]:
    return {"course": srch.Index(spark, posixpath.join(root, "course"), "course_id"),
            "person": srch.Index(spark, posixpath.join(root, "person"), "person_id")}


@dataclass
class Facets:
    """What limits results: departments to both kinds, the others to courses."""

    departments: Sequence[str] = ()
    categories: Sequence[str] = ()
    levels: Sequence[str] = ()
    min_units: float | None = None
    max_units: float | None = None

    def courses(self) -> Column:
        return flt.conjuncts(
            flt.has_category(CATEGORIES, self.categories),
            flt.any_of(flt.level_band("course_numeric", x) for x in self.levels) if self.levels else None,
            flt.unit_bounds("min_units", "max_units", self.min_units, self.max_units),
            F.col("department").isin(list(self.departments)) if self.departments else None)

    def people(self, tables: Tables) -> DataFrame:
        """People of departments named by the codes; names marked with a star stand for no department of their own."""
        if not self.departments:
            return tables["person_view"]
        named = tables["department"].where(F.col("department").isin(list(self.departments)) & ~F.col("department_name").endswith("*"))
        return tables["person_view"].join(named.select(F.col("department_name").alias("department")).distinct(), "department", "left_semi")


def search(tables: Tables, stored: Mapping[str, srch.Index], query: srch.Query, facets: Facets | None = None,
           kind: str | None = None, skip: int = 0, take: int = 90) -> tuple[DataFrame, DataFrame]:
    """(page of kind, id, rank, course, person; number of all results), by rank and then id.

    Department aliases in the words count for courses only. Without a `kind` both are searched and ranked together.
    Only the page is joined with its records.
    """
    facets, found = facets or Facets(), {}
    if kind in (None, "course"):
        aliased = replace(query, aliases=fixed.DEPARTMENT_ALIASES)
        only = tables["course_view"].where(facets.courses())
        limited = None if facets == Facets() else only
        found["course"] = srch.match_terms(stored["course"], "course_id", aliased, limited).withColumnRenamed("course_id", "id")
    if kind in (None, "person"):
        limited = facets.people(tables) if facets.departments else None
        found["person"] = srch.match_terms(stored["person"], "person_id", query, limited).withColumnRenamed("person_id", "id")
    if not found:
        raise ValueError(f"no such kind: {kind!r}")
    both = union_tagged(found)
    shown = page = both.orderBy(F.desc("rank"), "id", "kind").offset(skip).limit(take)
    for name, table, key in (("course", "course_view", "course_id"), ("person", "person_view", "person_id")):
        records = tables[table].select(F.lit(name).alias("kind"), F.col(key).alias("id"), F.struct("*").alias(name))
        # The page goes to the records, so that no more of them than it asks for are ever sent about.
        shown = shown.join(records.join(page, ["kind", "id"], "left_semi"), ["kind", "id"], "left")
    return shown.orderBy(F.desc("rank"), "id", "kind"), both.agg(F.count_if(F.col("rank") >= 0).alias("count"))

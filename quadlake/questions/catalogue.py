"""Courses, people, programs, sample programs and exam credit.

Tables and the columns read:
  course_view  course_id, department, course_number, course_numeric, title, description,
               min_units, max_units, ge_* flags
  person_view  person_id, name, title, department
  major        id, name, degree_id       degree  id, name, division
  major_year   major_id, catalog_year, specialization_required
  major_requirement_link  major_id, specialization_id (null: none), catalog_year, requirement_id
  requirement  id, requirements
  minor, minor_requirement (minor_id, catalog_year, requirements)
  specialization  id, major_id, name     specialization_requirement  specialization_id, catalog_year, requirements
  school_requirement  catalog_year, kind, requirements
  sample_program  program_id, name       variation  program_id, variation_id, label, years
  exam  exam, catalogue_name   reward  reward_id, ...   score  exam, score, reward_id
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import filters as flt
from quadlake.functions.project import positive_map
from quadlake.operators import aggs, joins, paging
from quadlake.questions.offerings import CATEGORIES

Tables = Mapping[str, DataFrame]


def _equal(col: str, value) -> Column | None:
    return None if value is None else F.col(col) == value


def course_filter(*, department: str | None = None, course_number: str | None = None, course_numeric: int | None = None,
                  title: str | None = None, level: str | None = None, min_units=None, max_units=None,
                  description: str | None = None, category: str | None = None) -> Column:
    return flt.conjuncts(
        _equal("department", department), _equal("course_number", course_number), _equal("course_numeric", course_numeric),
        flt.ilike_contains("title", title), flt.level_band("course_numeric", level, lower=0),
        flt.unit_bounds("min_units", "max_units", min_units, max_units), flt.ilike_contains("description", description),
        flt.has_category(CATEGORIES, [category] if category else None))


def courses_by_id(tables: Tables, ids) -> DataFrame:
    """One course, several, or as many as a DataFrame lists."""
    return flt.lookup(tables["course_view"], "course_id", ids)


def courses(tables: Tables, skip: int = 0, take: int = 100, **where) -> DataFrame:
    return paging.page(tables["course_view"].where(course_filter(**where)), "course_id", skip, take)


def courses_after(tables: Tables, cursor: str | None = None, take: int = 100, **where) -> tuple[DataFrame, DataFrame]:
    return paging.page_after(tables["course_view"].where(course_filter(**where)), "course_id", cursor, take)


def person_filter(*, name: str | None = None, title: str | None = None, department: str | None = None) -> Column:
    return flt.conjuncts(flt.ilike_contains("name", name), flt.ilike_contains("title", title),
                         flt.ilike_contains("department", department))


def people_by_id(tables: Tables, ids) -> DataFrame:
    return flt.lookup(tables["person_view"], "person_id", ids)


def people(tables: Tables, skip: int = 0, take: int = 100, **where) -> DataFrame:
    return paging.page(tables["person_view"].where(person_filter(**where)), "person_id", skip, take)


def people_after(tables: Tables, cursor: str | None = None, take: int = 100, **where) -> tuple[DataFrame, DataFrame]:
    return paging.page_after(tables["person_view"].where(person_filter(**where)), "person_id", cursor, take)


def majors(tables: Tables, major_id: str | None = None, catalog_year: str | None = None) -> DataFrame:
    """Majors of the best catalogue year with their specializations.

    The year is the latest, or the one nearest to the wanted year. It is chosen for
    the major asked for, or once for all majors together.
    """
    wanted = tables["major_year"].where(flt.conjuncts(_equal("major_id", major_id)))
    if catalog_year is None:
        latest = tables["major_year"].agg(F.max("catalog_year")).scalar()
        years = wanted.where(F.col("catalog_year") == latest)
    else:
        years = joins.nearest_year(wanted, [], "catalog_year", catalog_year, is_global=True)
    link = tables["major_requirement_link"].select("major_id", "catalog_year", "specialization_id")
    degree = tables["degree"].select(F.col("id").alias("degree_id"), F.col("name").alias("type"), "division")
    base = (tables["major"].withColumnRenamed("id", "major_id").join(degree, "degree_id").join(years, "major_id")
            .join(link, ["major_id", "catalog_year"]))
    keys = ["major_id", "name", "catalog_year", "specialization_required", "type", "division"]
    # A major has a handful of specializations.
    return base.groupBy(*keys).agg(F.array_sort(F.collect_set("specialization_id")).alias("specializations"))


def minors(tables: Tables, minor_id: str | None = None) -> DataFrame:
    return tables["minor"].where(flt.conjuncts(_equal("id", minor_id))).select("id", "name")


def specializations(tables: Tables, major_id: str | None = None, catalog_year: str | None = None) -> DataFrame:
    rows = tables["specialization"].where(flt.conjuncts(_equal("major_id", major_id)))
    if catalog_year is not None:
        link = tables["major_requirement_link"].where(flt.conjuncts(_equal("major_id", major_id)))
        best = joins.nearest_year(link, [], "catalog_year", catalog_year, is_global=True)
        chosen = best.select("major_id", F.col("specialization_id").alias("id")).where(F.col("id").isNotNull()).distinct()
        rows = rows.join(chosen, ["major_id", "id"], "left_semi")
    return rows.select("id", "major_id", "name").distinct()


def _best_year(rows: DataFrame, catalog_year: str | None) -> DataFrame:
    if catalog_year is None:
        return joins.latest_only(rows, "catalog_year")
    return joins.nearest_year(rows, [], "catalog_year", catalog_year, is_global=True)


def major_requirements(tables: Tables, major_id: str, specialization_id: str | None = None,
                       catalog_year: str | None = None) -> DataFrame:
    """Requirements of a major, without or with one specialization, in the nearest year."""
    link = tables["major_requirement_link"].where(
        (F.col("major_id") == major_id) & F.col("specialization_id").eqNullSafe(F.lit(specialization_id)))
    requirement = tables["requirement"].withColumnRenamed("id", "requirement_id")
    major = tables["major"].select(F.col("id").alias("major_id"), "name")
    return (_best_year(link, catalog_year).join(requirement, "requirement_id").join(major, "major_id")
            .select("major_id", "name", "catalog_year", "requirements"))


def minor_requirements(tables: Tables, minor_id: str, catalog_year: str | None = None) -> DataFrame:
    rows = tables["minor_requirement"].where(F.col("minor_id") == minor_id)
    return _best_year(rows, catalog_year).join(
        tables["minor"].select(F.col("id").alias("minor_id"), "name"), "minor_id")


def specialization_requirements(tables: Tables, specialization_id: str, catalog_year: str | None = None) -> DataFrame:
    rows = tables["specialization_requirement"].where(F.col("specialization_id") == specialization_id)
    return _best_year(rows, catalog_year).join(
        tables["specialization"].select(F.col("id").alias("specialization_id"), "name"), "specialization_id")


def school_requirements(tables: Tables, kind: str, catalog_year: str | None = None) -> DataFrame:
    return _best_year(tables["school_requirement"].where(F.col("kind") == kind), catalog_year)


def sample_programs(tables: Tables, program_id: str | None = None, page_size: int = 100) -> DataFrame:
    """Sample programs with their variations in order."""
    programs = tables["sample_program"].where(flt.conjuncts(_equal("program_id", program_id)))
    return aggs.nest(programs, tables["variation"], "program_id", ["variation_id"], None,
                     F.struct("label", "years"), "variations", page_size)


def exam_credit(tables: Tables, exam: str | None = None, catalogue_name: str | None = None) -> DataFrame:
    """Rewards of each exam with the scores that earn them; exams without rewards are left out."""
    exams = tables["exam"].where(flt.conjuncts(_equal("exam", exam), _equal("catalogue_name", catalogue_name)))
    scores = aggs.sorted_array_by(tables["score"], ["exam", "reward_id"], "score", "acceptable_scores")
    rewards = tables["reward"].drop("exam", "pos")
    granted = {code: col for code, col in CATEGORIES.items() if col in rewards.columns}
    return (exams.join(scores, "exam").join(rewards, "reward_id")
            .withColumn("categories_granted", positive_map(granted)).drop(*granted.values()))


def matching_departments(tables: Tables, codes: Sequence[str]) -> DataFrame:
    """People of the departments with the given codes; marked names are left out."""
    named = tables["department"].where(F.col("department").isin(list(codes)))
    return joins.semi_by_subquery(tables["person_view"], "department", named.select("department_name"), "department_name")

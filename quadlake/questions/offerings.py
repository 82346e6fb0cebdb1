"""Sections, grades, enrolment history, materials and tutoring.

Tables and the columns read:
  course    course_key, year, quarter, department, course_number, course_numeric,
            course_id, title, ge_* flags
  section   section_key, course_key, section_code, section_type, units, status,
            enrolled, total_enrolled, capacity, cancelled, web_url, r_* flags
  meeting   meeting_key, section_key, meeting_index, meets_* flags, start_minute, end_minute
  place     meeting_key, building, room
  staff     section_key, instructor
  grade     section_key, the eight counts, average
  snapshot  section_key, day, metrics
  material  section_key, material_key, author, title, edition, format, isbn, required
  tutoring  course_key, instructor, building, meets_* flags, start_minute, end_minute
  department year, quarter, department, department_name
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import filters as flt
from quadlake.functions import fixed
from quadlake.functions.project import collapse_term, pad_code, term_name
from quadlake.operators import aggs, joins, paging
from quadlake.operators.slices import id_block

Tables = Mapping[str, DataFrame]
CATEGORIES = {code: "ge_" + code[3:].lower() for code in fixed.CATEGORY_CODES}
DAYS = {day: "meets_" + day.lower() for day in fixed.DAY_TOKENS}
RESTRICTIONS = {code: "r_" + code.lower() for code in fixed.RESTRICTION_CODES}
LETTERS = ("a", "b", "c", "d", "f")
COUNTS = (*LETTERS, "p", "np", "w")
METRICS = ("total_enrolled", "capacity", "waitlist", "waitlist_cap", "requested", "reserved", "status")


def _equal(col: str, value) -> Column | None:
    return None if value is None else F.col(col) == value


def sections(tables: Tables, year: str, quarter: str, *, department: str | None = None, title: str | None = None,
             course_id: str | None = None, course_numbers: str | None = None, section_codes: str | None = None,
             instructor: str | None = None, days: str | None = None, building: str | None = None,
             room: str | None = None, level: str | None = None, section_type: str | None = None,
             fill: str | None = None, cancelled: str | None = None, units: str | None = None,
             after: str | None = None, before: str | None = None, category: str | None = None,
             exclude_restrictions: Sequence[str] | None = None, related: bool = False,
             cap: int | None = None) -> DataFrame:
    """Sections of a term; `related` adds all sections of every course with a match.

    Meeting and place conditions have to hold for one and the same meeting.
    """
    course = tables["course"].where(flt.conjuncts(
        F.col("year") == year, F.col("quarter") == quarter, _equal("department", department), _equal("title", title),
        _equal("course_id", course_id), flt.number_list("course_numeric", "course_number", course_numbers),
        flt.level_band("course_numeric", level), flt.has_category(CATEGORIES, [category] if category else None)))
    found = tables["section"].where(flt.conjuncts(
        flt.code_ranges("section_code", section_codes), _equal("section_type", section_type),
        flt.fill_status(fill, "status", "enrolled", "total_enrolled", "capacity"), flt.tristate("cancelled", cancelled),
        flt.units_is("units", units), flt.exclude_codes(RESTRICTIONS, exclude_restrictions)))
    at = [flt.any_day(DAYS, days), flt.time_window("start_minute", "end_minute", after, before)]
    where = [flt.eq_upper("building", building), flt.eq_upper("room", room)]
    if any(c is not None for c in (*at, *where)):
        meetings = tables["meeting"].where(flt.conjuncts(*at))
        if any(c is not None for c in where):
            meetings = meetings.join(tables["place"].where(flt.conjuncts(*where)), "meeting_key", "left_semi")
        found = joins.filter_via_bridge(found, meetings, F.lit(True), "section_key")
    if instructor is not None:
        found = joins.filter_via_bridge(found, tables["staff"], flt.ilike_prefix("instructor", instructor), "section_key")
    if related:
        matches = found.join(course.select("course_key"), "course_key", "left_semi")
        found = joins.expand_related(matches, tables["section"], "course_key", cap)
    return found.join(course, "course_key", "inner")


def terms(tables: Tables) -> DataFrame:
    """Terms on offer, latest first."""
    ordered = paging.order_terms(tables["course"], "year", "quarter")
    return ordered.select(term_name("year", "quarter").alias("short_name"),
                          term_name("year", "quarter", "long").alias("long_name"))


def departments(tables: Tables, since: tuple | None = None, until: tuple | None = None) -> DataFrame:
    """Newest name of each department that was on offer between the terms."""
    rows = tables["department"].where(flt.conjuncts(flt.term_between("year", "quarter", since, until)))
    version = F.struct("year", flt.term_ordinal("quarter"))
    return paging.distinct_on(rows, ["department"], version).select("department", "department_name").orderBy("department")


def syllabi(tables: Tables, course_id: str, year: str | None = None, quarter: str | None = None,
            instructor: str | None = None, page_size: int = 1000) -> DataFrame:
    """Syllabus links of a course with the instructors behind each, latest term first."""
    course = tables["course"].where(flt.conjuncts(
        F.col("course_id") == course_id, _equal("year", year), _equal("quarter", quarter)))
    linked = (tables["section"].where(flt.non_empty("web_url")).select("section_key", "course_key", "web_url")
              .join(course.select("course_key", "year", "quarter"), "course_key"))
    staff = tables["staff"].where(flt.conjuncts(_equal("instructor", instructor)))
    named = linked.join(staff, "section_key", "inner" if instructor is not None else "left")
    keys = ["year", "quarter", "web_url"]
    names = aggs.distinct_array_by(named, keys, "instructor", F.substring("instructor", 1, 2), "instructors", page_size)
    return (named.select(*keys).distinct().join(names, keys, "left")
            .withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
            .withColumn("instructors", F.coalesce("instructors", F.array().cast("array<string>")))
            .orderBy(F.col("year").desc(), flt.term_ordinal("quarter").desc(), "web_url", "page"))


def graded(tables: Tables, *, year: str | None = None, quarter: str | None = None, instructor: str | None = None,
           department: str | None = None, course_number: str | None = None, section_code: str | None = None,
           level: str | None = None, category: str | None = None, exclude_pass_only: bool = False) -> DataFrame:
    """Graded sections that match, one row each."""
    course = tables["course"].where(flt.conjuncts(
        _equal("year", year), _equal("quarter", quarter), _equal("department", department),
        _equal("course_number", course_number), flt.level_band("course_numeric", level),
        flt.has_category(CATEGORIES, [category] if category else None)))
    section = tables["section"].where(flt.conjuncts(
        None if section_code is None else F.col("section_code") == int(section_code)))
    grade = tables["grade"].where(flt.conjuncts(flt.any_positive(*LETTERS) if exclude_pass_only else None))
    found = (section.select("section_key", "course_key", "section_code").join(grade, "section_key")
             .join(course, "course_key"))
    if instructor is not None:
        found = joins.filter_via_bridge(found, tables["staff"], F.col("instructor") == instructor, "section_key")
    return found.withColumn("section_code", pad_code("section_code"))


def grades(tables: Tables, page_size: int = 1000, **where) -> DataFrame:
    """Graded sections with their instructors (paged) and the counts."""
    found = graded(tables, **where)
    staff = tables["staff"].join(found.select("section_key"), "section_key", "left_semi").distinct()
    return aggs.nest(found, staff, "section_key", ["instructor"], F.substring("instructor", 1, 2),
                     F.col("instructor"), "instructors", page_size)


def grade_options(tables: Tables, **where) -> DataFrame:
    """Values a caller can still pick in each of the four filters."""
    base = graded(tables, **where).join(tables["staff"], "section_key", "left")
    return aggs.facet_options(base, ["year", "department", "section_code", "instructor"])


def grade_totals(tables: Tables, **where) -> tuple[DataFrame, DataFrame]:
    """(one row of sums and the mean, the sections behind it)."""
    members = ["section_key", "year", "quarter", "section_code", "department", "course_number", "course_numeric"]
    return aggs.dist_total(graded(tables, **where), COUNTS, "average", members)


def grades_by_course(tables: Tables, **where) -> DataFrame:
    return aggs.dist_by(graded(tables, **where), ["department", "course_number"], COUNTS, "average")


def grades_by_offering(tables: Tables, **where) -> DataFrame:
    """Per course and instructor; sections without one count under STAFF."""
    staffed = graded(tables, **where).join(tables["staff"], "section_key", "left")
    staffed = staffed if where.get("instructor") is None else staffed.where(F.col("instructor") == where["instructor"])
    named = aggs.with_default(staffed, "instructor", "STAFF")
    return aggs.dist_by(named, ["department", "course_number", "instructor"], COUNTS, "average")


def enrollment_history(tables: Tables, *, year: str | None = None, quarter: str | None = None,
                       instructor: str | None = None, department: str | None = None, course_number: str | None = None,
                       section_code: int | None = None, section_type: str | None = None) -> DataFrame:
    """Daily vectors of located sections, one row per section and year of days."""
    course = tables["course"].where(flt.conjuncts(
        _equal("year", year), _equal("quarter", quarter), _equal("department", department),
        _equal("course_number", course_number)))
    section = tables["section"].where(flt.conjuncts(
        _equal("section_code", section_code), _equal("section_type", section_type)))
    found = section.select("section_key", "course_key", "section_code", "section_type").join(course, "course_key")
    if instructor is not None:
        found = joins.filter_via_bridge(found, tables["staff"], F.col("instructor") == instructor, "section_key")
    located = tables["meeting"].join(tables["place"].select("meeting_key"), "meeting_key", "left_semi")
    points = joins.history_base(found.select("section_key"), located, tables["snapshot"], "section_key")
    vectors = aggs.history_vectors(points, "section_key", "day", METRICS)
    return found.join(vectors, "section_key")


def materials(tables: Tables, *, year: str | None = None, quarter: str | None = None, instructor: str | None = None,
              department: str | None = None, course_numbers: str | None = None, section_code: str | None = None,
              author: str | None = None, title: str | None = None) -> DataFrame:
    """Course materials, one row each with its course; "Summer" stands for all summer sessions."""
    course = tables["course"].where(flt.conjuncts(
        _equal("year", year), None if quarter is None else F.col("quarter").isin(flt.expand_umbrella(quarter)),
        _equal("department", department), flt.number_list("course_numeric", "course_number", course_numbers)))
    section = tables["section"].where(flt.conjuncts(
        None if section_code is None else F.col("section_code") == int(section_code)))
    rows = tables["material"].where(flt.conjuncts(
        F.col("material_key").isNotNull(), flt.ilike_contains("author", author), flt.ilike_contains("title", title)))
    found = rows.join(section.select("section_key", "section_code", "course_key"), "section_key").join(
        course.select("course_key", "year", "quarter", "department", "course_number"), "course_key")
    if instructor is not None:
        found = joins.filter_via_bridge(found, tables["staff"], flt.ilike_contains("instructor", instructor), "section_key")
    return found.withColumn("quarter", collapse_term("quarter"))


def tutoring(tables: Tables, *, year: str | None = None, quarter: str | None = None, department: str | None = None,
             course_numbers: str | None = None, instructor: str | None = None, building: str | None = None,
             days: str | None = None, after: str | None = None, before: str | None = None,
             page_size: int = 1000) -> DataFrame:
    """Tutoring sections listed under their course, one row per page."""
    course = tables["course"].where(flt.conjuncts(
        _equal("year", year), _equal("quarter", quarter), _equal("department", department),
        flt.number_list("course_numeric", "course_number", course_numbers)))
    rows = tables["tutoring"].where(flt.conjuncts(
        flt.ilike_prefix("instructor", instructor), flt.eq_upper("building", building), flt.any_day(DAYS, days),
        flt.time_window("start_minute", "end_minute", after, before)))
    offered = course.join(rows.select("course_key").distinct(), "course_key", "left_semi")
    shown = [c for c in rows.columns if c != "course_key"]
    return aggs.nest(offered, rows, "course_key", ["start_minute", "instructor", "building"], id_block("start_minute", 15),
                     F.struct(*shown), "sections", page_size)

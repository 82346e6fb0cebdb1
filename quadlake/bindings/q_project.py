"""Projection queries."""

from pyspark.sql import functions as F

from quadlake.bindings.registry import query
from quadlake.bindings.roles import FLAGS, cte, role
from quadlake.functions import project as prj

ROOM_BASES = {"error": "https://rooms.example.org/space/"}
ROOM_DEFAULT = "https://library.example.org/space/"
LOCAL_TZ = "America/Los_Angeles"


@query("derive_ids", f"""
{cte('catalogue')}
SELECT course_key, replace(department, ' ', '') || course_number AS course_id,
       coalesce(TRY_CAST(nullif(regexp_replace(course_number, '\\D', '', 'g'), '') AS INTEGER), 0) AS course_numeric,
       replace(department, ' ', '') AS shortened_dept
FROM catalogue
""")
def derive_ids(t):
    courses = role(t, "catalogue").select("course_key", "department", "course_number")
    return (prj.derive_ids(courses, "department", "course_number")
            .select("course_key", "course_id", "course_numeric", "shortened_dept"))


_LIST_SQL = ", ".join(f"CASE WHEN {col} THEN '{code}' END" for code, col in FLAGS.items())


@query("flags_to_list", f"""
{cte('catalogue')}
SELECT course_key, concat_ws(',', {_LIST_SQL}) AS categories,
       CASE WHEN course_numeric < 100 THEN 'Lower Division (1-99)' WHEN course_numeric < 200 THEN 'Upper Division (100-199)'
            ELSE 'Graduate/Professional Only (200+)' END AS level
FROM catalogue
""")
def flags_to_list(t):
    names = {"LowerDiv": "Lower Division (1-99)", "UpperDiv": "Upper Division (100-199)",
             "Graduate": "Graduate/Professional Only (200+)"}
    return role(t, "catalogue").select(
        "course_key", F.array_join(prj.flags_to_list(FLAGS), ",").alias("categories"),
        prj.label(prj.level_of("course_numeric"), names).alias("level"))


@query("counts_to_map", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 > 0 THEN 'GE-1A=' || (p_size % 3) END,
  CASE WHEN p_size % 4 > 0 THEN 'GE-2=' || (p_size % 4) END,
  CASE WHEN p_size % 5 - 1 > 0 THEN 'GE-3=' || (p_size % 5 - 1) END) AS granted FROM part
""")
def counts_to_map(t):
    counted = t.part.select(
        "p_partkey", (F.col("p_size") % 3).alias("a"), (F.col("p_size") % 4).alias("b"),
        (F.col("p_size") % 5 - 1).alias("c"))
    granted = prj.positive_map({"GE-1A": "a", "GE-2": "b", "GE-3": "c"})
    pairs = F.transform(F.map_entries(granted), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return counted.select("p_partkey", F.array_join(pairs, ",").alias("granted"))


@query("display_normalize", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 5 THEN CAST(l_partkey AS VARCHAR)
       ELSE lpad(CAST(l_partkey AS VARCHAR), 5, '0') END AS code,
  CASE WHEN l_linenumber - 4 >= 0 THEN CAST(l_linenumber - 4 AS VARCHAR) ELSE '' END AS waitlist
FROM lineitem
""")
def display_normalize(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", prj.pad_code("l_partkey").alias("code"),
        prj.count_text(F.col("l_linenumber") - 4).alias("waitlist"))


_WEEK = ("CASE term WHEN 'Fall' THEN 'Fall Quarter' WHEN 'Winter' THEN 'Winter Quarter' "
         "WHEN 'Spring' THEN 'Spring Quarter' WHEN 'Summer1' THEN 'Summer Session I' "
         "WHEN 'Summer2' THEN 'Summer Session II' ELSE 'Summer Session 10WK' END")
_LONG = ("CASE term WHEN 'Fall' THEN 'Fall Quarter' WHEN 'Winter' THEN 'Winter Quarter' "
         "WHEN 'Spring' THEN 'Spring Quarter' WHEN 'Summer1' THEN 'Summer Session 1' "
         "WHEN 'Summer2' THEN 'Summer Session 2' ELSE '10-wk Summer' END")


@query("term_names", f"""
{cte('section')}
SELECT section_key, year || ' ' || term AS short_name, year || ' ' || {_LONG} AS long_name,
       {_WEEK} || ' ' || year AS week_name FROM section
""")
def term_names(t):
    return role(t, "section").select(
        "section_key",
        prj.term_name("year", "term").alias("short_name"),
        prj.term_name("year", "term", "long").alias("long_name"),
        prj.term_name("year", "term", "week").alias("week_name"))


@query("slot_urls_utc", f"""
{cte('slot')}, s AS (SELECT *, CASE WHEN slot_key % 5 = 0 THEN 'https://own.example.org/' || slot_key END AS url,
    CASE WHEN kind = 'error' THEN '{ROOM_BASES["error"]}' ELSE '{ROOM_DEFAULT}' END AS base,
    timezone('UTC', timezone('{LOCAL_TZ}', starts)) AS utc FROM slot)
SELECT slot_key, coalesce(url, base || room_key) AS room_url,
       coalesce(url, base || room_key || '?date=' || strftime(utc, '%Y-%m-%dT%H:%M:%SZ') || '#submit_times') AS slot_url,
       strftime(utc, '%Y-%m-%dT%H:%M:%S+00:00') AS starts_utc, strftime(starts, '%Y-%m-%d') AS local_day
FROM s
""")
def slot_urls_utc(t):
    slots = role(t, "slot").withColumn(
        "url", F.when(F.col("slot_key") % 5 == 0, F.concat(F.lit("https://own.example.org/"), "slot_key")))
    return slots.select(
        "slot_key",
        prj.room_url("url", "kind", "room_key", ROOM_BASES, ROOM_DEFAULT).alias("room_url"),
        prj.slot_url("url", "kind", "room_key", "starts", LOCAL_TZ, ROOM_BASES, ROOM_DEFAULT).alias("slot_url"),
        prj.utc_text("starts", LOCAL_TZ, "+00:00").alias("starts_utc"),
        prj.iso_day("starts").alias("local_day"))

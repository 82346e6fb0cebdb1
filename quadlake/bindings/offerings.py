"""Graded offerings over the order tables: customer = course, order = section,
order lines by return flag = grade counts, suppliers of the lines = instructors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.sources.scan import Tables

GRADED_SQL = """WITH courses AS (SELECT c_custkey AS course_key, c_mktsegment AS department, c_nationkey AS number FROM customer),
sections AS (SELECT o_orderkey AS section_key, o_custkey AS course_key, CAST(year(o_orderdate) AS STRING) AS year FROM orders),
grades AS (SELECT l_orderkey AS section_key, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
  count(*) FILTER (l_returnflag = 'R') AS r, avg(l_discount) * 12.7323954 AS average FROM lineitem GROUP BY 1),
staff AS (SELECT DISTINCT l_orderkey AS section_key, s_name AS instructor FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0)"""

COUNTS = ["a", "n", "r"]


def offering_frames(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(course, section, grade, section-to-instructor bridge)."""
    course = t.customer.select(
        F.col("c_custkey").alias("course_key"), F.col("c_mktsegment").alias("department"),
        F.col("c_nationkey").alias("number"))
    section = t.orders.select(
        F.col("o_orderkey").alias("section_key"), F.col("o_custkey").alias("course_key"),
        F.year("o_orderdate").cast("string").alias("year"))
    grade = t.lineitem.groupBy(F.col("l_orderkey").alias("section_key")).agg(
        *[F.count_if(F.col("l_returnflag") == c.upper()).alias(c) for c in COUNTS],
        (F.avg("l_discount") * 12.7323954).alias("average"))
    staff = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("instructor"))
    bridge = (t.lineitem.select(F.col("l_orderkey").alias("section_key"), "l_suppkey").distinct()
              .join(staff, "l_suppkey").select("section_key", "instructor"))
    return course, section, grade, bridge


def graded_offerings(t: Tables) -> DataFrame:
    """One row per graded section with its course columns."""
    course, section, grade, _ = offering_frames(t)
    return section.join(grade, "section_key").join(course, "course_key")

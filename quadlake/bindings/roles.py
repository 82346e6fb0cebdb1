"""Roles the supplied tables play: course, section, meeting, grade, snapshot.

Each role is a list of expressions valid in both SQL dialects, so the Spark side
and the SQL check start from the same rows; everything after that is separate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadlake.functions import fixed
from quadlake.sources.scan import Tables

_TERM = ("CASE WHEN month({d}) <= 3 THEN 'Winter' WHEN month({d}) <= 5 THEN 'Spring' "
         "WHEN month({d}) = 6 THEN 'Summer1' WHEN month({d}) = 7 THEN 'Summer10wk' "
         "WHEN month({d}) = 8 THEN 'Summer2' ELSE 'Fall' END")

FLAGS = {code: "ge_" + code[3:].lower() for code in fixed.CATEGORY_CODES}
DAY_FLAGS = {day: "meets_" + day.lower() for day in fixed.DAY_TOKENS}
RESTRICTIONS = {code: "r_" + code.lower() for code in fixed.RESTRICTION_CODES}

_NUMBER = ("CASE WHEN p_partkey % 10 = 0 THEN 'H' ELSE '' END || CAST(p_size * 5 AS STRING) || "
           "CASE WHEN p_partkey % 3 = 1 THEN 'A' WHEN p_partkey % 3 = 2 THEN 'B' ELSE '' END")

ROLES: dict[str, tuple[str, list[str]]] = {
    # Catalogue course.
    "catalogue": ("part", [
        "p_partkey AS course_key",
        "replace(p_brand, '#', ' ') AS department",
        f"{_NUMBER} AS course_number",
        "p_size * 5 AS course_numeric",
        "p_name AS title",
        "p_type AS category",
        "p_size % 4 + 1 AS min_units",
        "CAST(p_size % 4 + 1 + p_partkey % 3 AS INT) AS max_units",
        "p_retailprice AS price",
        *[f"p_partkey % {k} = 0 AS {flag}" for k, flag in enumerate(FLAGS.values(), start=2)],
    ]),
    # Offered section: one order.
    "section": ("orders", [
        "o_orderkey AS section_key",
        "o_custkey AS course_key",
        "CAST(o_orderkey % 97999 + 1 AS INT) AS section_code",
        "CAST(year(o_orderdate) AS STRING) AS year",
        f"{_TERM.format(d='o_orderdate')} AS term",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'O' THEN 'OPEN' "
        "WHEN o_orderstatus = 'F' THEN 'FULL' ELSE 'Waitl' END AS status",
        "CAST(o_orderkey % 120 AS INT) AS enrolled",
        "CAST(o_orderkey % 120 + o_custkey % 7 AS INT) AS total_enrolled",
        "CAST(60 + o_custkey % 50 AS INT) AS capacity",
        "o_totalprice AS price",
        "o_orderdate AS opened",
        *[f"o_orderkey % {k} = 0 AS {flag}" for k, flag in enumerate(DAY_FLAGS.values(), start=3)],
    ]),
    # Staffed line: section line with its instructor.
    "staffed": ("lineitem", [
        "l_orderkey AS section_key",
        "l_linenumber AS line",
        "l_partkey AS course_key",
        "l_suppkey AS instructor_key",
        "l_quantity AS quantity",
        "l_returnflag = 'R' AS cancelled",
        "l_returnflag AS flag",
        "l_linestatus AS status",
        *[f"(l_partkey + l_linenumber) % {k} = 0 AS {flag}"
          for k, flag in enumerate(RESTRICTIONS.values(), start=5)],
    ]),
    # Timed row: [ts, ts + value minutes).
    "slot": ("events", [
        "event_id AS slot_key",
        "user_id AS room_key",
        "event_type AS kind",
        "ts AS starts",
        "ts + INTERVAL 1 MINUTE * CAST(floor(value) AS INT) AS ends",
        "hour(ts) * 60 + minute(ts) AS start_min",
        "hour(ts) * 60 + minute(ts) + CAST(floor(value) AS INT) AS end_min",
        "value",
    ]),
    # Place with a text of its own: one customer.
    "place": ("customer", [
        "c_custkey AS place_key",
        "c_nationkey",
        "c_nationkey % 5 AS area",
    ]),
    # Letter and other grade marks, one per event; a section is one (user, day).
    "mark": ("events", [
        "user_id AS course_key",
        "user_id % 12 AS department",
        "user_id % 40 AS number",
        "CAST(ts AS DATE) AS day",
        "event_type AS mark",
        "value",
    ]),
}

MARKS = {"a": "signup", "b": "purchase", "c": "view", "d": "click", "f": "error"}


def role(t: Tables, name: str) -> DataFrame:
    table, exprs = ROLES[name]
    return getattr(t, table).selectExpr(*exprs)


def cte(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the roles a SQL check starts from."""
    parts = []
    for name in names:
        table, exprs = ROLES[name]
        parts.append(f"{name} AS (SELECT {', '.join(exprs)} FROM {table})")
    return "WITH " + ", ".join(parts)

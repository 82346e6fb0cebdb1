"""Raw texts built from the supplied tables, as expressions valid in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadlake.sources.scan import Tables

RAW: dict[str, tuple[str, list[str]]] = {
    # Meeting days and times.
    "meeting": ("events", [
        "event_id",
        "CASE event_type WHEN 'view' THEN 'MWF' WHEN 'click' THEN 'TuTh' WHEN 'signup' THEN 'Sa'"
        " WHEN 'purchase' THEN 'SuTh' ELSE 'TBA' END AS days",
        "CASE WHEN event_type = 'error' THEN 'TBA' ELSE CAST(hour(ts) % 12 + 1 AS STRING) || ':'"
        " || lpad(CAST(minute(ts) AS STRING), 2, '0') || '-' || CAST(user_id % 12 + 1 AS STRING) || ':'"
        " || lpad(CAST(event_id % 60 AS STRING), 2, '0') || CASE WHEN value > 30 THEN 'p'"
        " ELSE '' END END AS time",
    ]),
    # Final-exam texts.
    "exam": ("orders", [
        "o_orderkey",
        "year(o_orderdate) AS year",
        "CASE WHEN o_orderstatus = 'O' THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'TBA' ELSE 'Wed '"
        " || CASE WHEN month(o_orderdate) <= 6 THEN 'Mar' ELSE 'Dec' END || ' '"
        " || CAST(day(o_orderdate) AS STRING) || ' ' || CAST(o_custkey % 12 + 1 AS STRING) || ':30-'"
        " || CAST(o_orderkey % 12 + 1 AS STRING) || ':00' || CASE"
        " WHEN o_orderpriority = '5-LOW' THEN 'am' ELSE 'pm' END || CASE"
        " WHEN o_orderpriority = '2-HIGH' THEN '' ELSE ' @ HALL ' || CAST(o_custkey AS STRING)"
        " || ', LAB 2' END END AS exam",
        "'ROOM ' || CAST(o_custkey AS STRING) AS room",
    ]),
    # Section counts as listed.
    "count": ("lineitem", [
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "CAST(l_linenumber AS STRING) AS section_code",
        "CAST(20 + l_linenumber AS STRING) AS max_capacity",
        "'7' AS requested",
        "CASE l_returnflag WHEN 'A' THEN 'n/a' WHEN 'N' THEN 'off (' || CAST(l_suppkey AS STRING) || ')'"
        " ELSE ' ' || CAST(l_suppkey AS STRING) || ' ' END AS waitlist",
        "CASE WHEN l_linestatus = 'O' THEN '' ELSE CAST(l_linenumber AS STRING) END AS waitlist_cap",
        "CAST(NULL AS STRING) AS reserved",
        "CASE WHEN l_quantity > 45 THEN 'x'"
        " ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS section_enrolled",
        "'' AS total_enrolled",
        "CASE WHEN l_returnflag = 'R' THEN 'NewOnly' END AS status",
        "CASE l_linestatus WHEN 'O' THEN 'A and B or X' ELSE 'ABX or S' END AS restrictions",
    ]),
    # Catalogue blocks around the page texts.
    "block": ("pages", [
        "page_id",
        "'P&D X' AS department",
        "'P&D X ' || CASE WHEN page_id % 9 = 0 THEN 'H' ELSE '' END || CAST(page_id % 290 AS STRING)"
        " || 'B.' AS code",
        "regexp_extract(html, '<h1>([^<]*)</h1>', 1) || '.  ' AS title",
        "CASE page_id % 4 WHEN 0 THEN '1-4 Units.' WHEN 1 THEN '4 Units.' WHEN 2 THEN '1.3 Unit'"
        " ELSE '' END AS units",
        "regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS description",
        "CASE page_id % 5 WHEN 0 THEN '(II, Vb ).' WHEN 1 THEN '(IIIa and VIII)' WHEN 2 THEN 'II'"
        " ELSE '' END AS ge_text",
        "'Prerequisites:  ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || '. ' AS prerequisite_text",
        "'' AS corequisites",
        "'' AS concurrent",
        "'Same as A 1.' AS same_as",
        "'' AS overlap",
        "'' AS restriction",
        "'' AS grading_option",
        "CASE WHEN page_id % 6 = 5 THEN '' ELSE 'Repeatability: ' END || CASE page_id % 6"
        " WHEN 0 THEN 'May be taken for credit 2 times.'"
        " WHEN 1 THEN 'May be taken for credit for 12 units.' WHEN 2 THEN 'Unlimited as topics vary.'"
        " WHEN 3 THEN 'May be taken 3 times.' WHEN 4 THEN 'Who knows.' ELSE '' END AS repeatability",
    ]),
    # Requirement texts: a graded single, an OR group, a corequisite and an exclusion.
    "prereq": ("part", [
        "p_partkey",
        "'ANDY ' || CAST(p_partkey AS STRING) || ' ( min grade = C ) AND ( B ' || CAST(p_size AS STRING)"
        " || ' OR AP MUSIC OR C D' || CAST(p_size + 1 AS STRING)"
        " || ' ( min score = 3 ) OR ??? ) AND NO X ' || CAST(p_size AS STRING) || CASE"
        " WHEN p_type = 'PROMO' THEN ' AND NO AP ART score of 3 or greater'"
        " ELSE ' AND E 5 ( coreq )' END || CASE WHEN p_size < 10 THEN ' AND ( ??? )' ELSE '' END AS text",
    ]),
    # Course patterns of degree rules.
    "pattern": ("orders", [
        "o_orderstatus AS req",
        "'Brand' || CAST(o_custkey % 25 + 1 AS STRING) || ' ' || CASE o_orderpriority"
        " WHEN '1-URGENT' THEN '@' WHEN '2-HIGH' THEN CAST(o_custkey % 3 + 1 AS STRING) || '@@'"
        " WHEN '3-MEDIUM' THEN CAST(o_custkey % 9 + 1 AS STRING) || '@'"
        " WHEN '4-NOT SPECIFIED' THEN CAST(o_custkey % 100 AS STRING) || 'A-'"
        " || CAST(o_custkey % 100 + 40 AS STRING) ELSE CAST(o_custkey % 50 * 5 AS STRING)"
        " || 'A' END AS pattern",
    ]),
    # Tutoring cards.
    "card": ("orders", [
        "o_orderkey",
        "'I&C D' || CAST(o_custkey % 9 AS STRING) || ' ' || CAST(o_custkey AS STRING) || 'A' || CASE"
        " WHEN o_orderstatus = 'F' THEN ' (same as X 1)' ELSE '' END || ' - LARC (Title)' AS header",
        "CASE WHEN o_orderstatus = 'O' THEN 'Mon/Wed' ELSE 'Tue/Thu' END AS days",
        "CAST(o_orderkey % 11 + 1 AS STRING) || ':00 ' || CASE"
        " WHEN o_orderpriority = '5-LOW' THEN 'AM-11:50 AM' ELSE 'PM-11:50 PM' END AS time",
        "CASE WHEN o_orderstatus = 'P' THEN 'Online' ELSE 'HALL' END AS building",
    ]),
}


def raw_rows(t: Tables, name: str) -> DataFrame:
    table, exprs = RAW[name]
    return getattr(t, table).selectExpr(*exprs)


def raw_cte(name: str, distinct: bool = False) -> str:
    """`raw AS (SELECT ...)` for the SQL checks."""
    table, exprs = RAW[name]
    return f"raw AS (SELECT {'DISTINCT ' if distinct else ''}{', '.join(exprs)} FROM {table})"

"""Aggregation queries."""

from pyspark.sql import functions as F

from quadlake.bindings.offerings import COUNTS, GRADED_SQL, graded_offerings, offering_frames
from quadlake.bindings.registry import query
from quadlake.bindings.roles import FLAGS, MARKS, cte, role
from quadlake.functions import filters as flt
from quadlake.operators import aggs
from quadlake.operators.slices import id_block


@query("dedupe_first", """
SELECT l_orderkey, min(l_linenumber) AS l_linenumber,
  arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey
""")
def dedupe_first(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (aggs.dedupe_first(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
            .select("l_orderkey", "l_linenumber", "l_partkey"))


LETTERS = list(MARKS)
_MARK_COLS = ", ".join(f"count(*) FILTER (mark = '{m}') AS {k}" for k, m in MARKS.items())
_GRADED_DAYS = (f"{cte('mark')}, graded AS (SELECT course_key, department, number, day, {_MARK_COLS}, "
                "count(*) FILTER (value > 100) AS w, avg(value) / 125 AS average FROM mark GROUP BY 1, 2, 3, 4)")
_SUMS = ", ".join(f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS {c}" for c in [*LETTERS, "w"])


def graded_days(t):
    """One graded section per (user, day): counts of marks and the mean value."""
    return role(t, "mark").groupBy("course_key", "department", "number", "day").agg(
        *[F.count_if(F.col("mark") == m).alias(k) for k, m in MARKS.items()],
        F.count_if(F.col("value") > 100).alias("w"),
        (F.avg("value") / 125).alias("average"))


@query("dist_total", f"""
{_GRADED_DAYS}
SELECT 'some' AS form, {_SUMS}, round(avg(average), 4) AS average FROM graded WHERE department = 3 AND (a > 0 OR b > 0)
UNION ALL
SELECT 'none', {_SUMS}, round(avg(average), 4) FROM graded WHERE department = 99
""")
def dist_total(t):
    sections = graded_days(t)
    counts = [*LETTERS, "w"]

    def totals(form, where):
        total, _ = aggs.dist_total(sections.where(where), counts, "average", ["course_key", "day"])
        return total.select(F.lit(form).alias("form"), *counts, F.round("average", 4).alias("average"))

    some = flt.conjuncts(F.col("department") == 3, flt.any_positive("a", "b"))
    return totals("some", some).unionByName(totals("none", F.col("department") == 99))


@query("dist_by_group", f"""
{_GRADED_DAYS}
SELECT department, number, {_SUMS}, round(avg(average), 4) AS average FROM graded
WHERE a > 0 OR b > 0 OR c > 0 GROUP BY department, number
""")
def dist_by_group(t):
    counts = [*LETTERS, "w"]
    sections = graded_days(t).where(flt.any_positive("a", "b", "c"))
    return (aggs.dist_by(sections, ["department", "number"], counts, "average")
            .withColumn("average", F.round("average", 4)))


@query("dist_by_group_default", f"""
{GRADED_SQL}
SELECT department, number, coalesce(instructor, 'STAFF') AS instructor,
  CAST(sum(a) AS BIGINT) AS a, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS r, round(avg(average), 4) AS average
FROM sections JOIN grades USING (section_key) JOIN courses USING (course_key) LEFT JOIN staff USING (section_key)
GROUP BY 1, 2, 3
""")
def dist_by_group_default(t):
    _, _, _, bridge = offering_frames(t)
    offered = aggs.with_default(graded_offerings(t).join(bridge, "section_key", "left"), "instructor", "STAFF")
    return (aggs.dist_by(offered, ["department", "number", "instructor"], COUNTS, "average")
            .withColumn("average", F.round("average", 4)))


@query("facet_options", f"""
{GRADED_SQL}, b AS (SELECT * FROM sections JOIN grades USING (section_key) JOIN courses USING (course_key)
  LEFT JOIN staff USING (section_key) WHERE a > 2)
SELECT 'year' AS facet, year AS value FROM b UNION SELECT 'department', department FROM b
UNION SELECT 'section_key', CAST(section_key AS VARCHAR) FROM b
UNION SELECT 'instructor', instructor FROM b WHERE instructor IS NOT NULL
""")
def facet_options(t):
    _, _, _, bridge = offering_frames(t)
    base = graded_offerings(t).where("a > 2").join(bridge, "section_key", "left")
    return aggs.facet_options(base, ["year", "department", "section_key", "instructor"])


@query("agg_sorted_array", """
SELECT l_suppkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS scores
FROM lineitem WHERE l_linenumber <> 4 GROUP BY l_suppkey
""")
def agg_sorted_array(t):
    # Line numbers stand for exam scores: a fixed domain of a few values.
    scores = t.lineitem.select("l_suppkey", F.nullif("l_linenumber", F.lit(4)).alias("score"))
    return (aggs.sorted_array_by(scores, ["l_suppkey"], "score", "scores")
            .withColumn("scores", F.array_join("scores", ",")))


@query("nest_children", """
WITH ranked AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn
  FROM orders WHERE o_totalprice > 250000)
SELECT c_custkey, CAST(coalesce(rn // 5, 0) AS BIGINT) AS page,
  coalesce(string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey), '') AS sections
FROM customer LEFT JOIN ranked ON o_custkey = c_custkey GROUP BY 1, 2
""")
def nest_children(t):
    parent = t.customer.select("c_custkey")
    child = t.orders.where("o_totalprice > 250000").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    item = F.struct("o_orderkey", "o_orderstatus")
    nested = aggs.nest(parent, child, "c_custkey", ["o_orderkey"], id_block("o_orderkey"), item,
                       "sections", page_size=5)
    shown = F.transform("sections", lambda s: F.concat(s["o_orderkey"], s["o_orderstatus"]))
    return nested.withColumn("sections", F.array_join(shown, ","))


@query("nest_four_levels", """
WITH leaves AS (SELECT r_name AS school, n_name AS department, c_custkey AS course_key, o_orderkey,
  row_number() OVER (PARTITION BY r_name, n_name, c_custkey ORDER BY o_orderkey) - 1 AS rn
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)
SELECT school, department, course_key, CAST(rn // 8 AS BIGINT) AS page, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS sections
FROM leaves GROUP BY 1, 2, 3, 4
""")
def nest_four_levels(t):
    from quadlake.bindings.q_joins import hierarchy_join

    path = ["school", "department", "course_key"]
    nested = aggs.nest_levels(hierarchy_join(t), path, ["section_key"], id_block("section_key"),
                              F.col("section_key"), "sections", page_size=8)
    return nested.withColumn("sections", F.array_join("sections", ","))


@query("agg_distinct_array", """
WITH named AS (SELECT DISTINCT year(o_orderdate) AS year, o_orderstatus, s_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority <> '5-LOW' AND s_acctbal > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY year, o_orderstatus ORDER BY s_suppkey) - 1 AS rn FROM named)
SELECT year, o_orderstatus, CAST(rn // 25 AS BIGINT) AS page, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS instructors
FROM ranked GROUP BY 1, 2, 3
""")
def agg_distinct_array(t):
    staff = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    orders = t.orders.where(flt.non_empty(F.nullif("o_orderpriority", F.lit("5-LOW")))).select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("bigint").alias("year"), "o_orderstatus")
    linked = t.lineitem.select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").join(staff, "l_suppkey")
    arrays = aggs.distinct_array_by(linked, ["year", "o_orderstatus"], "l_suppkey", id_block("l_suppkey"),
                                    "instructors", page_size=25)
    return arrays.withColumn("instructors", F.array_join("instructors", ","))


@query("agg_map", """
WITH d AS (SELECT DISTINCT l_returnflag AS period, l_linestatus AS station, l_partkey FROM lineitem WHERE l_quantity > 45),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period, station ORDER BY l_partkey) - 1 AS rn FROM d),
lists AS (SELECT period, station, rn // 100 AS page, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS dishes FROM ranked GROUP BY 1, 2, 3)
SELECT period, CAST(page AS BIGINT) AS page, string_agg(station || ':' || dishes, ';' ORDER BY station) AS stations FROM lists GROUP BY 1, 2
""")
def agg_map(t):
    dishes = t.lineitem.where("l_quantity > 45").select(
        F.col("l_returnflag").alias("period"), F.col("l_linestatus").alias("station"), "l_partkey")
    nested = aggs.nest_map(dishes, "period", "station", "l_partkey", id_block("l_partkey"), "stations", page_size=100)
    shown = F.transform(F.map_entries("stations"),
                        lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], ",")))
    return nested.withColumn("stations", F.array_join(F.array_sort(shown), ";"))


@query("date_range", """
SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS earliest, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest FROM orders
""")
def date_range(t):
    span = aggs.date_range(t.orders.select(F.col("o_orderdate").cast("date").alias("d")), "d")
    return span.select(F.col("earliest").cast("string"), F.col("latest").cast("string"))


_FLAG_UNION = " UNION ALL ".join(
    f"SELECT '{code}' AS category, count(*) FILTER ({col}) AS fetched, count(*) FILTER ({col} AND category <> 'PROMO') AS stored FROM catalogue"
    for code, col in FLAGS.items())


@query("flag_counts_reconcile", f"""
{cte('catalogue')}
SELECT category, fetched, stored, greatest(fetched - stored, 0) AS missing FROM ({_FLAG_UNION})
""")
def flag_counts_reconcile(t):
    courses = role(t, "catalogue")
    stored = courses.where("category <> 'PROMO'")
    return aggs.reconcile(aggs.flag_counts(courses, FLAGS, "fetched"), aggs.flag_counts(stored, FLAGS, "stored"))


@query("history_vectors", """
WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS v, arg_min(event_type, (ts, event_id)) AS k
  FROM events GROUP BY 1, 2)
SELECT user_id, year(d) AS history_year, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS dates,
  string_agg(CASE WHEN k = 'error' THEN '' ELSE CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) END, ',' ORDER BY d) AS enrolled,
  string_agg(k, ',' ORDER BY d) AS status
FROM daily GROUP BY 1, 2
""")
def history_vectors(t):
    from quadlake.operators.temporal import daily_first

    daily = daily_first(t.events, "user_id", "ts", tie="event_id").select(
        "user_id", F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_type") != "error", F.floor("value")).alias("enrolled"),
        F.col("event_type").alias("status"))
    vectors = aggs.history_vectors(daily, "user_id", "day", ["enrolled", "status"])
    lists = ["dates", "enrolled", "status"]
    return vectors.select("user_id", F.col("history_year").cast("bigint").alias("history_year"),
                          *[F.array_join(c, ",").alias(c) for c in lists])


@query("group_intersection", """
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS section, l_orderkey AS course, any_value(CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'A' ELSE 'b' END) AS g
  FROM lineitem GROUP BY 1, 2),
b AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS section, l_suppkey % 4 AS who FROM lineitem),
pairs AS (SELECT x.section, x.course, x.g, y.section AS peer FROM s x JOIN s y ON x.course = y.course AND (x.g = '' OR x.g = y.g)),
need AS (SELECT section, count(*) AS n FROM pairs GROUP BY 1),
got AS (SELECT pairs.section, who, count(*) AS n FROM pairs JOIN b ON b.section = peer GROUP BY 1, 2),
shared AS (SELECT section, who FROM got JOIN need USING (section, n))
SELECT section, who FROM shared UNION ALL
SELECT section, who FROM b WHERE section NOT IN (SELECT section FROM shared)
""")
def group_intersection(t):
    number = (F.when(F.col("l_linenumber") % 3 == 0, F.lit("1")).when(F.col("l_linenumber") % 3 == 1, "A1")
              .otherwise("1b"))
    section = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section")
    sections = t.lineitem.select(section, F.col("l_orderkey").alias("course"), number.alias("number")).distinct()
    bridge = t.lineitem.select(section, (F.col("l_suppkey") % 4).alias("who"))
    return aggs.group_intersection(sections, bridge, "section", "course", "number", "who")


@query("merge_duplicates", """
WITH m AS (SELECT l_orderkey, l_returnflag, l_linestatus, (l_partkey * 100 + l_linenumber) * 100000 + l_suppkey AS pos, l_suppkey, l_partkey FROM lineitem),
items AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, pos, i, CASE i WHEN 0 THEN 'B' || l_suppkey ELSE 'R' || l_partkey END AS v FROM m, (VALUES (0), (1)) x(i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY pos, i, v) - 1 AS rn,
  min(pos) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS first_pos FROM items)
SELECT l_orderkey, l_returnflag, l_linestatus, CAST(rn // 6 AS BIGINT) AS page, first_pos, string_agg(v, ',' ORDER BY rn) AS buildings
FROM ranked GROUP BY 1, 2, 3, 4, 5
""")
def merge_duplicates(t):
    # (part, line, supplier) orders the meetings of a section; repeated rows are one meeting.
    meetings = t.lineitem.select(
        "l_orderkey", "l_returnflag", "l_linestatus",
        ((F.col("l_partkey") * 100 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("pos"),
        F.array(F.concat(F.lit("B"), "l_suppkey"), F.concat(F.lit("R"), "l_partkey")).alias("buildings"))
    keys = ["l_orderkey", "l_returnflag", "l_linestatus"]
    merged = aggs.merge_duplicates(meetings.distinct(), keys, "buildings", "pos", page_size=6,
                                   width=100 * 100_000 * 1000)
    return merged.withColumn("buildings", F.array_join("buildings", ","))


@query("childless_flag_reset", """
SELECT c_custkey, c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000) AS required FROM customer
""")
def childless_flag_reset(t):
    parent = t.customer.select("c_custkey", (F.col("c_acctbal") > 0).alias("required"))
    child = t.orders.where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return aggs.reset_childless(parent, child, "c_custkey", "required")


@query("course_view", f"""
{cte('section')}, taught AS (SELECT DISTINCT l_partkey, l_suppkey, s.year || ' ' || s.term AS term FROM lineitem
  JOIN section s ON section_key = l_orderkey),
staffed AS (SELECT DISTINCT l_partkey, l_suppkey, s_name FROM taught JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS rn FROM staffed),
terms AS (SELECT l_partkey, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM taught GROUP BY 1),
pages AS (SELECT l_partkey, CAST(rn // 10 AS BIGINT) AS page, string_agg(l_suppkey || ':' || s_name, ';' ORDER BY l_suppkey) AS instructors FROM ranked GROUP BY 1, 2)
SELECT p_partkey AS course_key, p_name AS title, coalesce(page, 0) AS page, coalesce(instructors, '') AS instructors, coalesce(terms, '') AS terms
FROM part LEFT JOIN terms t ON t.l_partkey = p_partkey LEFT JOIN pages g ON g.l_partkey = p_partkey
""")
def course_view(t):
    from quadlake.plans.views import course_view as build

    view = build(*view_tables(t), page_size=10)
    shown = F.transform("instructors", lambda i: F.concat_ws(":", i["person_key"], i["name"]))
    return view.select("course_key", "title", "page", F.array_join(shown, ";").alias("instructors"),
                       F.array_join("terms", ",").alias("terms"))


@query("person_view", f"""
{cte('section')}, taught AS (SELECT DISTINCT l_partkey, l_suppkey, s.year || ' ' || s.term AS term FROM lineitem
  JOIN section s ON section_key = l_orderkey WHERE l_suppkey <> 0),
pairs AS (SELECT l_suppkey, l_partkey, p_name, string_agg(term, '/' ORDER BY term) AS terms FROM taught JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS rn FROM pairs),
pages AS (SELECT l_suppkey, CAST(rn // 50 AS BIGINT) AS page, string_agg(l_partkey || ':' || p_name || ':' || terms, ';' ORDER BY l_partkey) AS courses FROM ranked GROUP BY 1, 2)
SELECT s_suppkey AS person_key, s_name AS name, coalesce(page, 0) AS page, coalesce(courses, '') AS courses
FROM supplier LEFT JOIN pages ON l_suppkey = s_suppkey WHERE s_suppkey <> 0
""")
def person_view(t):
    from quadlake.plans.views import person_view as build

    view = build(*view_tables(t), page_size=50)
    shown = F.transform("courses", lambda c: F.concat_ws(
        ":", c["course_key"], c["title"], F.array_join(c["terms"], "/")))
    return view.select("person_key", "name", "page", F.array_join(shown, ";").alias("courses"))


def view_tables(t):
    """(courses, people, taught): taught holds one row per staffed line with its term."""
    courses = t.part.select(F.col("p_partkey").alias("course_key"), F.col("p_name").alias("title"))
    people = t.supplier.select(F.col("s_suppkey").alias("person_key"), F.col("s_name").alias("name"))
    terms = role(t, "section").select("section_key", F.concat_ws(" ", "year", "term").alias("term"))
    taught = (t.lineitem.select(F.col("l_orderkey").alias("section_key"), F.col("l_partkey").alias("course_key"),
                                F.col("l_suppkey").alias("person_key"))
              .join(terms, "section_key").drop("section_key"))
    # Supplier 0 plays the redacted person that the views leave out.
    return courses, people, taught, F.col("person_key") != 0

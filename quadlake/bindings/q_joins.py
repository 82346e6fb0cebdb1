"""Join queries: hierarchy, bridges, intervals, nearest year, resolution."""

from pyspark.sql import functions as F

from quadlake.bindings.offerings import GRADED_SQL, offering_frames
from quadlake.bindings.registry import query
from quadlake.bindings.roles import cte, role
from quadlake.functions import fixed
from quadlake.operators import joins as jn


@query("hierarchy_join", """
SELECT r_name AS school, n_name AS department, c_custkey AS course_key, o_orderkey AS section_key
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey
""")
def hierarchy_join(t):
    levels = [t.region, t.nation, t.customer, t.orders]
    keys = [("r_regionkey", "n_regionkey"), ("n_nationkey", "c_nationkey"), ("c_custkey", "o_custkey")]
    return jn.hierarchy(levels, keys).select(
        F.col("r_name").alias("school"), F.col("n_name").alias("department"),
        F.col("c_custkey").alias("course_key"), F.col("o_orderkey").alias("section_key"))


@query("filter_via_bridge", """
SELECT DISTINCT o_orderkey, o_orderstatus, o_totalprice FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey
WHERE s_name LIKE '%7' AND l_quantity > 40
""")
def filter_via_bridge(t):
    bridge = t.lineitem.join(t.supplier, t.lineitem.l_suppkey == t.supplier.s_suppkey, "inner")
    condition = F.col("s_name").like("%7") & (F.col("l_quantity") > 40)
    return jn.filter_via_bridge(
        t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"),
        bridge, condition, "o_orderkey", "l_orderkey")


@query("related_expand", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')
""")
def related_expand(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    matches = t.lineitem.where((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R"))
    return jn.expand_related(matches, lines, "l_orderkey")


@query("grades_raw", f"""
{GRADED_SQL}
SELECT section_key, department, number, instructor, a, n, r, round(average, 4) AS average
FROM sections JOIN grades USING (section_key) JOIN courses USING (course_key) LEFT JOIN staff USING (section_key)
WHERE department = 'BUILDING' AND a > 0
""")
def grades_raw(t):
    course, section, grade, bridge = offering_frames(t)
    condition = (F.col("department") == "BUILDING") & (F.col("a") > 0)
    return (jn.grades_base(course, section, grade, bridge, "course_key", ["section_key"], condition)
            .select("section_key", "department", "number", "instructor", "a", "n", "r",
                    F.round("average", 4).alias("average")))


@query("history_base", """
SELECT user_id, event_id, value, c_nationkey FROM events JOIN customer ON c_custkey = user_id
WHERE c_mktsegment <> 'MACHINERY' AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
""")
def history_base(t):
    section = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    located = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"))
    snapshots = t.events.select("user_id", "event_id", "value")
    return (jn.history_base(section, located, snapshots, "user_id", F.col("c_mktsegment") != "MACHINERY")
            .select("user_id", "event_id", "value", "c_nationkey"))


def prerequisite_edges(t):
    """Derived edges: a part needs the parts at 7k+1 and 3k+2 below its own key."""
    return t.part.select(
        F.col("p_partkey").alias("dependent_key"),
        F.explode(F.array(F.floor(F.col("p_partkey") / 7), F.floor(F.col("p_partkey") / 3))).alias("needed_key"),
    ).where("dependent_key <> needed_key")


EDGES_SQL = """edges AS (SELECT DISTINCT p_partkey AS dependent_key, CAST(floor(p_partkey / k) AS BIGINT) AS needed_key
  FROM part, (VALUES (7), (3)) v(k) WHERE p_partkey <> CAST(floor(p_partkey / k) AS BIGINT))"""


@query("prereq_both_ways", f"""
WITH {EDGES_SQL}, both_ways AS (
  SELECT dependent_key AS course_key, 'prerequisite' AS direction, needed_key AS other FROM edges
  UNION ALL SELECT needed_key, 'dependent', dependent_key FROM edges),
ranked AS (SELECT course_key, direction, other, p_name,
  row_number() OVER (PARTITION BY course_key, direction ORDER BY other) - 1 AS rn
  FROM both_ways JOIN part ON p_partkey = other)
SELECT course_key, direction, CAST(rn // 4 AS BIGINT) AS page,
       string_agg(other || ':' || p_name, ';' ORDER BY other) AS related
FROM ranked GROUP BY 1, 2, 3
""")
def prereq_both_ways(t):
    from quadlake.operators.slices import id_block, paged_lists

    nodes = t.part.select(F.col("p_partkey").alias("course_key"), "p_name")
    long = jn.neighbours_both_ways(
        prerequisite_edges(t), nodes, "course_key", "dependent_key", "needed_key", ["p_name"])
    pages = paged_lists(long, ["course_key", "direction"], ["neighbour"], id_block("neighbour"),
                        F.concat_ws(":", "neighbour", "p_name"), "related", page_size=4)
    return pages.withColumn("related", F.array_join("related", ";"))


@query("null_safe_join", """
WITH majors AS (SELECT o_orderkey, year(o_orderdate) AS year, nullif(o_orderpriority, '5-LOW') AS spec FROM orders),
rules AS (SELECT year, spec, count(*) AS n, min(o_orderkey) AS first_key FROM majors GROUP BY 1, 2)
SELECT o_orderkey, m.year, m.spec, n, first_key FROM majors m
JOIN rules r ON m.year = r.year AND m.spec IS NOT DISTINCT FROM r.spec
""")
def null_safe_join(t):
    majors = t.orders.select(
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("spec"))
    rules = (majors.groupBy("year", "spec")
             .agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")))
    return jn.join_null_safe(majors, rules, ["year"], ["spec"])


@query("unmatched_anti", """
SELECT c_name FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' AND c_name NOT IN (
  SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000)
""")
def unmatched_anti(t):
    links = (t.orders.join(t.customer, t.orders.o_custkey == t.customer.c_custkey)
             .select("c_name", F.when(F.col("o_totalprice") > 450000, F.col("o_orderkey")).alias("linked")))
    names = t.customer.where("c_mktsegment <> 'HOUSEHOLD'").select("c_name")
    return jn.unmatched(names, links, "c_name", "linked")


@query("semi_in_subquery", """
SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey IN (
  SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND NOT n_name LIKE '%3')
""")
def semi_in_subquery(t):
    listed = t.nation.where(F.col("n_regionkey").isin(1, 3)).select(
        F.col("n_nationkey").cast("string").alias("code"), "n_name")
    marked = listed.select(F.when(F.col("n_name").like("%3"), F.concat("code", F.lit("*")))
                           .otherwise(F.col("code")).alias("code"))
    suppliers = t.supplier.withColumn("code", F.col("s_nationkey").cast("string"))
    return (jn.semi_by_subquery(suppliers, "code", marked, "code")
            .select("s_suppkey", "s_name", "s_nationkey"))


_YEARS_SQL = """WITH y AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS STRING) || CAST(year(o_orderdate) + 1 AS STRING) AS catalog_year FROM orders),
scored AS (SELECT *, CASE WHEN catalog_year >= '19981999' THEN CAST(substr(catalog_year, 1, 4) AS INT) - 1998
   ELSE 1998 - CAST(substr(catalog_year, 1, 4) AS INT) + 0.5 END AS score FROM y)"""


def catalog_years(t):
    year = F.year("o_orderdate")
    return t.orders.select("o_custkey", "o_orderkey",
                           F.concat(year.cast("string"), (year + 1).cast("string")).alias("catalog_year"))


@query("nearest_year", f"""
{_YEARS_SQL}, best AS (SELECT o_custkey, min(score) AS score FROM scored GROUP BY 1)
SELECT o_custkey, o_orderkey, catalog_year, 'entity' AS form FROM scored JOIN best USING (o_custkey, score)
UNION ALL
SELECT o_custkey, o_orderkey, catalog_year, 'global' FROM scored WHERE score = (SELECT min(score) FROM scored)
""")
def nearest_year(t):
    years = catalog_years(t)
    each = jn.nearest_year(years, ["o_custkey"], "catalog_year", "19981999")
    overall = jn.nearest_year(years, [], "catalog_year", "19981999", is_global=True)
    cols = ["o_custkey", "o_orderkey", "catalog_year"]
    return (each.select(*cols).withColumn("form", F.lit("entity"))
            .unionByName(overall.select(*cols).withColumn("form", F.lit("global"))))


@query("latest_partition", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)
""")
def latest_partition(t):
    years = t.orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return jn.latest_only(years, "year")


@query("interval_contains", """
WITH ranges AS (SELECT o_orderstatus || o_orderpriority AS range_key, DATE '2023-12-20' + CAST(count(*) % 35 AS INT) AS lo,
  DATE '2023-12-20' + CAST(count(*) % 35 + count(*) % 13 AS INT) AS hi FROM orders GROUP BY 1)
SELECT event_id, range_key FROM events JOIN ranges ON CAST(ts AS DATE) BETWEEN lo AND hi
""")
def interval_contains(t):
    first = F.lit("2023-12-20").cast("date")
    ranges = (t.orders.groupBy(F.concat("o_orderstatus", "o_orderpriority").alias("range_key"))
              .agg(F.count("*").alias("n"))
              .select("range_key", F.date_add(first, (F.col("n") % 35).cast("int")).alias("lo"),
                      F.date_add(first, (F.col("n") % 35 + F.col("n") % 13).cast("int")).alias("hi")))
    points = t.events.select("event_id", F.col("ts").cast("date").alias("d"))
    return jn.interval_contains(points, ranges, "d", "lo", "hi").select("event_id", "range_key")


SCHEDULES_SQL = """schedules AS (
  SELECT event_type || '-' || lpad(CAST(day(ts) AS STRING), 2, '0') AS schedule, min(event_id) AS pos,
         CASE WHEN day(ts) % 4 = 1 THEN min(CAST(ts AS DATE)) END AS lo,
         CASE WHEN day(ts) % 4 = 1 THEN min(CAST(ts AS DATE)) + 1 END AS hi,
         CASE WHEN day(ts) % 4 = 1 THEN 'special' ELSE 'standard' END AS kind
  FROM events GROUP BY event_type, day(ts))"""


def schedules(t):
    special = F.dayofmonth("ts") % 4 == 1
    grouped = (t.events.groupBy("event_type", F.dayofmonth("ts").alias("d"))
               .agg(F.min("event_id").alias("pos"), F.min(F.col("ts").cast("date")).alias("first")))
    special = F.col("d") % 4 == 1
    return grouped.select(
        F.concat("event_type", F.lit("-"), F.lpad(F.col("d").cast("string"), 2, "0")).alias("schedule"),
        "pos", F.when(special, F.col("first")).alias("lo"),
        F.when(special, F.date_add("first", 1)).alias("hi"),
        F.when(special, "special").otherwise("standard").alias("kind"))


@query("interval_or_default", f"""
WITH {SCHEDULES_SQL}, d AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events),
first AS (SELECT d.day, min_by(schedule, pos) AS s FROM (SELECT DISTINCT day FROM d) d
  JOIN schedules ON d.day BETWEEN lo AND hi GROUP BY d.day)
SELECT event_id, coalesce(s, (SELECT min_by(schedule, pos) FROM schedules WHERE kind = 'standard')) AS active
FROM d LEFT JOIN first ON d.day = first.day
""")
def interval_or_default(t):
    days = t.events.select("event_id", F.col("ts").cast("date").alias("day"))
    return (jn.interval_or_default(days, schedules(t), "day", "schedule", "lo", "hi", "pos",
                                   F.col("kind") == "standard").select("event_id", "active"))


@query("calendar_expand", """
WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS hi FROM orders),
days AS (SELECT o_orderkey, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM p)
SELECT o_orderkey, CAST(date AS VARCHAR) AS date,
  CASE dayofweek(date) WHEN 0 THEN NULL WHEN 6 THEN '09:00-11:00' WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN '07:15-10:00' END
       ELSE '07:15-11:00' END AS day_hours
FROM days WHERE dayofweek(date) <> 0 AND NOT (dayofweek(date) = 5 AND o_orderkey % 2 <> 0)
""")
def calendar_expand(t):
    open_days = F.array(
        F.lit(None), *[F.lit("07:15-11:00")] * 4,
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("07:15-10:00")), F.lit("09:00-11:00"))
    start = F.col("o_orderdate").cast("date")
    periods = t.orders.select(
        "o_orderkey", start.alias("lo"),
        F.date_add(start, (F.col("o_orderkey") % 9).cast("int")).alias("hi"), open_days.alias("hours"))
    return jn.expand_calendar(periods, "lo", "hi", "hours").select(
        "o_orderkey", F.col("date").cast("string").alias("date"), "day_hours")


@query("validity_semi", """
SELECT event_id FROM events WHERE (day(ts), event_type) IN (
  SELECT day(o_orderdate), CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'F' THEN 'click' ELSE 'error' END
  FROM orders)
""")
def validity_semi(t):
    period = (F.when(F.col("o_orderstatus") == "O", "view").when(F.col("o_orderstatus") == "F", "click")
              .otherwise("error"))
    valid = t.orders.select(
        F.dayofmonth("o_orderdate").alias("day"), period.alias("event_type"))
    facts = t.events.select("event_id", "event_type", F.dayofmonth("ts").alias("day"))
    return jn.keep_valid(facts, valid, ["day", "event_type"]).select("event_id")


@query("ci_mapping_join", """
WITH m AS (SELECT s_suppkey, CASE s_name WHEN 'Supplier#000000003' THEN 'nation_7' ELSE 'NaTion_' || s_nationkey END AS degree, s_nationkey AS since FROM supplier),
n AS (SELECT lower(n_name) AS k, n_nationkey, n_regionkey FROM nation WHERE n_nationkey >= 6)
SELECT s_suppkey, degree, n_nationkey, r_name AS division FROM m JOIN n ON lower(degree) = k JOIN region ON r_regionkey = n_regionkey
UNION ALL
SELECT s_suppkey, degree, NULL, NULL FROM m WHERE lower(degree) NOT IN (SELECT k FROM n)
""")
def ci_mapping_join(t):
    from quadlake.plans.programs import map_case_insensitive

    left = t.supplier.select(
        "s_suppkey", "s_name", F.concat(F.lit("NaTion_"), "s_nationkey").alias("degree"))
    mid = t.nation.where("n_nationkey >= 6").select("n_name", "n_nationkey", "n_regionkey")
    right = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("division"))
    mapped, missing = map_case_insensitive(
        left, mid, right, "degree", "n_name", "n_regionkey",
        aliases={"Supplier#000000003": "nation_7"}, alias_on="s_name")
    cols = ["s_suppkey", "degree", "n_nationkey", "division"]
    return mapped.select(*cols).unionByName(missing.select("s_suppkey", "degree"), allowMissingColumns=True)


@query("lookup_tagged", """
WITH rows_ AS (SELECT p_partkey AS row_key, p_brand AS dept, p_size FROM part),
cells AS (SELECT row_key, i AS pos, 'D' || substr(dept, 7) || ' ' || (p_size + i * 30) AS raw FROM rows_, (VALUES (0), (1), (2)) v(i)),
cat AS (SELECT 'D' || substr(p_brand, 7) || ' ' || p_size AS raw, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT row_key, string_agg(CASE WHEN id IS NULL THEN 'unknown:' || c.raw ELSE 'courseId:' || id END, '|' ORDER BY pos) AS entries
FROM cells c LEFT JOIN cat ON c.raw = cat.raw GROUP BY row_key
""")
def lookup_tagged(t):
    dept = F.concat(F.lit("D"), F.substring("p_brand", 7, 10), F.lit(" "))
    cells = t.part.select(
        F.col("p_partkey").alias("row_key"), F.posexplode(F.array(*[
            F.concat(dept, (F.col("p_size") + i * 30).cast("string")) for i in range(3)])).alias("pos", "raw"))
    catalogue = (t.part.groupBy(F.concat(dept, F.col("p_size").cast("string")).alias("raw"))
                 .agg(F.min("p_partkey").alias("id")))
    out = jn.lookup_tagged(cells, catalogue, "raw", ["row_key"], "pos", "id")
    entries = F.transform("entries", lambda e: F.concat_ws(":", e["type"], e["value"]))
    return out.select("row_key", F.array_join(entries, "|").alias("entries"))


@query("latest_dim", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest_key, c_mktsegment
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_mktsegment
""")
def latest_dim(t):
    dim = t.orders.select("o_custkey", F.col("o_orderkey").alias("newest_key"),
                          F.struct("o_orderdate", "o_orderkey").alias("version"))
    newest = jn.latest_dim(dim, "o_custkey", "version").select("o_custkey", "newest_key")
    segment = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return newest.join(segment, "o_custkey")


@query("section_key_join", f"""
{cte('section')}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(l_shipdate) AS STRING) AS year,
  CASE WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' WHEN month(l_shipdate) <= 3 THEN 'Winter'
       WHEN month(l_shipdate) <= 5 THEN 'Spring' ELSE 'Fall' END AS term,
  CAST(l_orderkey % 97999 + 1 AS INT) AS section_code FROM lineitem)
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, min(section_key) AS section_key
FROM r JOIN section s ON s.year = r.year AND s.section_code = r.section_code
  AND (s.term = r.term OR (r.term = 'Summer' AND s.term LIKE 'Summer%'))
GROUP BY r.l_orderkey, r.l_linenumber, r.l_partkey, r.year, r.term
""")
def section_key_join(t):
    month = F.month("l_shipdate")
    term = (F.when(month.isin(6, 7, 8), "Summer").when(month <= 3, "Winter").when(month <= 5, "Spring")
            .otherwise("Fall"))
    records = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").cast("string").alias("year"),
        term.alias("term"), (F.col("l_orderkey") % 97999 + 1).cast("int").alias("section_code"))
    matched = jn.attach_section_key(
        records, role(t, "section"), ["year", "term", "section_code"], "term", "section_key",
        {"Summer": fixed.SUMMER_SESSIONS})
    return matched.select("l_orderkey", "l_linenumber", "l_partkey", "section_key")


@query("required_one_to_one", """
WITH big AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
open_ AS (SELECT o_custkey AS k, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 GROUP BY 1)
SELECT c_custkey, top, n_open, CASE WHEN top IS NULL AND n_open IS NULL THEN 'nutrition,diet'
   WHEN top IS NULL THEN 'nutrition' WHEN n_open IS NULL THEN 'diet' ELSE '' END AS missing
FROM (SELECT c_custkey, top, n_open FROM customer LEFT JOIN big b ON b.k = c_custkey LEFT JOIN open_ o ON o.k = c_custkey) x
""")
def required_one_to_one(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    big = orders.where("o_totalprice > 300000").groupBy("c_custkey").agg(F.max("o_totalprice").alias("top"))
    opened = (orders.where("o_orderstatus = 'O' AND o_totalprice > 100000").groupBy("c_custkey")
              .agg(F.count("*").alias("n_open")))
    parent = t.customer.select("c_custkey")
    whole, violations = jn.require_one_to_one(parent, "c_custkey", {"nutrition": big, "diet": opened})
    partial = (violations.join(big, "c_custkey", "left").join(opened, "c_custkey", "left")
               .withColumn("missing", F.array_join("missing", ",")))
    return whole.withColumn("missing", F.lit("")).unionByName(partial)

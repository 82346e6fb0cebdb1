"""Queries for the small operators that larger ones build on."""

from pyspark.sql import functions as F

from quadlake.bindings.q_aggs import course_view
from quadlake.bindings.q_programs import pattern_catalogue
from quadlake.bindings.raw_texts import raw_cte, raw_rows
from quadlake.bindings.registry import ORACLES, query
from quadlake.bindings.roles import cte, role
from quadlake.functions import filters as flt
from quadlake.functions import project as prj
from quadlake.operators import diff, temporal
from quadlake.operators import joins as jn
from quadlake.operators.slices import id_block, paged_lists
from quadlake.plans import dining, listings, programs, rooms, rules


@query("filter_units", f"""
{cte('catalogue')}
SELECT course_key, CASE WHEN min_units = max_units THEN CAST(min_units AS VARCHAR) ELSE min_units || '-' || max_units END AS units
FROM catalogue WHERE min_units <> max_units OR min_units = 4
""")
def filter_units(t):
    units = F.when(F.col("min_units") == F.col("max_units"), F.col("min_units").cast("string")).otherwise(
        F.concat_ws("-", "min_units", "max_units"))
    courses = role(t, "catalogue").select("course_key", units.alias("units"))
    return courses.where(flt.any_of([flt.units_is("units", "VAR"), flt.units_is("units", "4")]))


@query("filter_eq_upper", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
""")
def filter_eq_upper(t):
    where = flt.conjuncts(flt.eq_upper("l_returnflag", "r"), flt.eq_upper("l_linestatus", "f"))
    return t.lineitem.where(where).select("l_orderkey", "l_linenumber")


@query("filter_non_empty", """
SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'O' THEN '' WHEN o_orderstatus = 'F' THEN o_orderpriority END <> ''
""")
def filter_non_empty(t):
    link = F.when(F.col("o_orderstatus") == "O", "").when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return t.orders.withColumn("link", link).where(flt.non_empty("link")).select("o_orderkey")


@query("level_labels", f"""
{cte('catalogue')}
SELECT course_key, CASE WHEN course_numeric < 100 THEN 'Lower' WHEN course_numeric < 200 THEN 'Upper' END AS level,
  CAST(CAST(min_units AS DECIMAL(4, 2)) AS VARCHAR) AS min_units FROM catalogue
""")
def level_labels(t):
    return role(t, "catalogue").select(
        "course_key", prj.label(prj.level_of("course_numeric"), {"LowerDiv": "Lower", "UpperDiv": "Upper"}).alias("level"),
        F.col("min_units").cast("decimal(4,2)").cast("string").alias("min_units"))


@query("time_display", f"""
{cte('slot')}
SELECT slot_key, strftime(starts, '%Y-%m-%d') AS day, CAST(end_min // 60 AS INTEGER) AS hour, CAST(end_min % 60 AS INTEGER) AS minute FROM slot
""")
def time_display(t):
    return (role(t, "slot").select("slot_key", prj.iso_day("starts").alias("day"), prj.hour_minute("end_min").alias("x"))
            .select("slot_key", "day", "x.hour", "x.minute"))


@query("attach_offering", f"""
{cte('section')}, o AS (SELECT year, term, 'D ' || (course_key % 20) AS department, CAST(course_key % 50 AS VARCHAR) AS course_number, min(section_key) AS section_key FROM section GROUP BY 1, 2, 3, 4),
c AS (SELECT event_id, CAST(1995 + user_id % 7 AS VARCHAR) AS year, CASE event_type WHEN 'view' THEN 'Fall' WHEN 'click' THEN 'Winter' ELSE 'Spring' END AS term,
  'D ' || (user_id % 20) AS department, CAST(event_id % 50 AS VARCHAR) AS course_number FROM events)
SELECT event_id, department, course_number, section_key FROM c JOIN o USING (year, term, department, course_number)
""")
def attach_offering(t):
    offerings = role(t, "section").select(
        "year", "term", F.concat(F.lit("D "), (F.col("course_key") % 20).cast("string")).alias("department"),
        (F.col("course_key") % 50).cast("string").alias("course_number"), "section_key")
    term = F.when(F.col("event_type") == "view", "Fall").when(F.col("event_type") == "click", "Winter").otherwise("Spring")
    cards = t.events.select(
        "event_id", (F.col("user_id") % 7 + 1995).cast("string").alias("year"), term.alias("term"),
        F.concat(F.lit("D "), (F.col("user_id") % 20).cast("string"), F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("course"))
    return (jn.attach_offering(cards, offerings, "year", "term", "course", "section_key")
            .select("event_id", "department", "course_number", "section_key"))


@query("meeting_buildings", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS rn FROM d)
SELECT l_orderkey, CAST(rn // 4 AS BIGINT) AS page, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY rn) AS meetings FROM r GROUP BY 1, 2
""")
def meeting_buildings(t):
    # Distinct (section, meeting, building), listed under the section in meeting order.
    located = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    slice_by = F.struct("l_linenumber", id_block("l_suppkey"))
    pages = paged_lists(located, ["l_orderkey"], ["l_linenumber", "l_suppkey"], slice_by,
                        F.concat_ws(":", "l_linenumber", "l_suppkey"), "meetings", page_size=4)
    return pages.withColumn("meetings", F.array_join("meetings", ","))


@query("latest_parent", """
SELECT p_brand, arg_max(p_type, p_partkey) AS college FROM part GROUP BY p_brand
""")
def latest_parent(t):
    parents = t.part.select("p_brand", F.col("p_type").alias("college"), F.col("p_partkey").alias("pos"))
    return jn.latest_dim(parents, "p_brand", "pos").select("p_brand", "college")


@query("sort_codes", """
WITH c AS (SELECT p_partkey, unnest([10 - p_size % 7, p_size, 5]) AS n, unnest(['B', 'A', 'B']) AS dept, unnest(['x', 'y', 'a']) AS s FROM part)
SELECT p_partkey, string_agg(dept || n || s, ',' ORDER BY dept, n, s) AS codes FROM c GROUP BY p_partkey
""")
def sort_codes(t):
    def code(dept, numeric, text):
        return F.struct(F.lit(dept).alias("dept"), numeric.alias("n"), F.lit(text).alias("s"))

    codes = F.array(code("B", 10 - F.col("p_size") % 7, "x"), code("A", F.col("p_size"), "y"), code("B", F.lit(5), "a"))
    shown = F.transform(prj.sort_codes(codes), lambda c: F.concat(c["dept"], c["n"], c["s"]))
    return t.part.select("p_partkey", F.array_join(shown, ",").alias("codes"))


@query("intersect_arrays", """
SELECT p_partkey, CASE WHEN p_size BETWEEN 2 AND 4 THEN CAST(p_size AS VARCHAR) ELSE '' END AS shared FROM part
""")
def intersect_arrays(t):
    lists = t.part.select(
        "p_partkey", F.array(F.col("p_size"), F.lit(99)).alias("a"), F.array(*map(F.lit, (1, 2, 3, 4))).alias("b"),
        F.array(*map(F.lit, (5, 4, 3, 2))).alias("c"))
    return lists.select("p_partkey", F.array_join(diff.intersect_all("a", "b", "c").cast("array<string>"), ",").alias("shared"))


@query("minus_keys", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)
""")
def minus_keys(t):
    excluded = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return diff.minus_keys(t.part.select("p_partkey"), excluded, "p_partkey")


@query("schedule_periods", f"""
{cte('place')}
SELECT place_key, area AS period_id, '07:15' AS open_mo, CASE WHEN c_nationkey > 9 THEN '10:00' END AS close_su FROM place
""")
def schedule_periods(t):
    hours = F.when(F.col("c_nationkey") > 9, "Mo-Su 07:15-10:00").otherwise("Mo-Fr 07:15-11:00")
    named = role(t, "place").join(t.region, F.col("area") == F.col("r_regionkey"))
    schedules = named.select("place_key", F.array(
        F.struct(F.col("r_name").alias("period"), hours.alias("hours")),
        F.struct(F.lit("NO SUCH PERIOD").alias("period"), hours.alias("hours"))).alias("meal_periods"))
    periods = t.region.select(F.col("r_name").alias("period"), F.col("r_regionkey").alias("period_id"))
    return dining.schedule_periods(schedules, periods).select("place_key", "period_id", "open_mo", "close_su")


@query("specialization_advice", """
SELECT p_partkey, p_type IN ('PROMO', 'ECONOMY') AND p_size > 20 AS required FROM part
""")
def specialization_advice(t):
    advice = (F.when(F.col("p_type") == "PROMO", F.array(F.lit("Pick one"), F.lit("Declare a Concentration")))
              .when(F.col("p_type") == "ECONOMY", F.array(F.lit("contact advisor to select a specialization.")))
              .when(F.col("p_type") == "SMALL", F.array(*[F.lit(x) for x in rules.NOT_REQUIRED_ADVICE]))
              .otherwise(F.array(F.lit("More units needed"))))
    part = F.when(F.col("p_size") > 20, "ElsePart").otherwise("IfPart")
    audits = t.part.select("p_partkey", F.array(F.struct(part.alias("if_else_part"), advice.alias("advice"))).alias("r"))
    return audits.select("p_partkey", rules.needs_specialization("r").alias("required"))


@query("normalize_tutoring", f"""
WITH {raw_cte('card')}
SELECT o_orderkey, 'I&C D' || regexp_extract(header, 'D([0-9]+) ', 1) AS department, regexp_extract(header, ' ([0-9]+A)', 1) AS course_number, days = 'Mon/Wed' AS monday, days <> 'Mon/Wed' AS thursday,
  CASE WHEN time LIKE '%PM%' THEN 720 ELSE 0 END + CAST(split_part(time, ':', 1) AS INTEGER) * 60 AS start_minute,
  CASE WHEN time LIKE '%PM%' THEN 1430 ELSE 710 END AS end_minute, CASE building WHEN 'Online' THEN 'ON LINE' ELSE building END AS building FROM raw
""")
def normalize_tutoring(t):
    out = listings.normalize_tutoring(raw_rows(t, "card"))
    return out.select("o_orderkey", "department", "course_number", F.col("meets_m").alias("monday"),
                      F.col("meets_th").alias("thursday"), "start_minute", "end_minute", "building")


@query("refresh_slots", f"""
{cte('slot')}, o AS (SELECT DISTINCT room_key AS room, date_trunc('hour', starts) AS s, kind FROM slot WHERE starts < TIMESTAMP '2024-01-20' AND kind <> 'error'),
old AS (SELECT room, s, max(kind) AS kind FROM o GROUP BY 1, 2),
new AS (SELECT room_key AS room, date_trunc('hour', starts) AS s, nullif(max(kind), 'view') AS kind FROM slot WHERE starts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT coalesce(n.room, o.room) AS room, strftime(coalesce(n.s, o.s), '%Y-%m-%d %H') AS starts, coalesce(n.kind, o.kind) AS kind
FROM old o FULL JOIN new n ON o.room = n.room AND o.s = n.s WHERE coalesce(n.s, o.s) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-12'
""")
def refresh_slots(t):
    hour = F.date_trunc("hour", "starts").cast("timestamp_ntz")
    slots = role(t, "slot").select(
        F.col("room_key").alias("room"), hour.alias("starts"), (hour + F.expr("INTERVAL 1 HOUR")).alias("ends"), "kind",
        F.col("starts").alias("at"))
    keys = ["room", "starts", "ends"]
    old = slots.where("at < TIMESTAMP_NTZ '2024-01-20' AND kind <> 'error'").groupBy(*keys).agg(F.max("kind").alias("kind"))
    new = (slots.where("at >= TIMESTAMP_NTZ '2024-01-15'").groupBy(*keys).agg(F.max("kind").alias("kind"))
           .withColumn("kind", F.nullif("kind", F.lit("view"))))
    out = rooms.refresh_slots(old, new, "2024-01-12 00:00:00")
    return out.select("room", F.date_format("starts", "yyyy-MM-dd HH").alias("starts"), "kind")


@query("active_terms", """
SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey
HAVING min(o_orderdate) <= TIMESTAMP '1996-01-01' AND max(o_orderdate) >= TIMESTAMP '1996-01-01'
""")
def active_terms(t):
    terms = t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("opens"), F.max("o_orderdate").alias("closes"), F.min("o_orderkey").alias("first_key"))
    return temporal.active_terms(terms, "opens", "closes", "1996-01-01 00:00:00").select("o_custkey", "first_key")


@query("first_block", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS n FROM orders WHERE o_orderstatus <> 'O'
""")
def first_block(t):
    def block(kind, value, n):
        return F.concat(F.lit(f'{{"requirementType":"{kind}","requirementValue":"'), value, F.lit(f'","n":{n}}}'))

    key = F.col("o_custkey").cast("string")
    found = F.when(F.col("o_orderstatus") == "F", block("MAJOR", key, 1)).otherwise(block("MINOR", key, 1))
    last = F.when(F.col("o_orderstatus") == "O", block("MAJOR", F.lit("none"), 2)).otherwise(block("MAJOR", key, 2))
    doc = F.concat(F.lit("["), block("DEGREE", key, 0), F.lit(","), found, F.lit(","), last, F.lit("]"))
    audits = t.orders.select("o_orderkey", "o_custkey", F.parse_json(doc).alias("blocks"))
    hit = rules.first_block(audits, ["o_orderkey"], "blocks", "MAJOR", F.col("o_custkey").cast("string"))
    return hit.select("o_orderkey", F.try_variant_get("block", "$.n", "int").alias("n"))


_REQ_COURSES = f"""
{cte('catalogue')}, {raw_cte('pattern', distinct=True)},
c AS (SELECT DISTINCT replace(department, ' ', '') AS dept, course_number AS num, course_numeric AS n, CAST(min_units AS INTEGER) AS lo, max(CAST(max_units AS INTEGER)) AS hi FROM catalogue GROUP BY 1, 2, 3, 4),
p AS (SELECT req, split_part(pattern, ' ', 1) AS dept, split_part(pattern, ' ', 2) AS pat FROM raw),
e AS (SELECT DISTINCT req, CASE WHEN pat = '@' THEN 'in' WHEN pat LIKE '%@@' THEN 'in4' WHEN pat LIKE '%@' THEN 'out' WHEN pat LIKE '%-%' THEN 'out4' ELSE 'in' END AS role, c.dept || num AS course_id, lo, hi
  FROM p JOIN c ON c.dept = p.dept AND CASE WHEN pat = '@' THEN true WHEN pat LIKE '%@@' THEN regexp_matches(num, '^' || replace(pat, '@@', '') || '\\w{{2,}}')
    WHEN pat LIKE '%@' THEN regexp_matches(num, '^' || replace(pat, '@', '') || '\\w+')
    WHEN pat LIKE '%-%' THEN n BETWEEN CAST(regexp_replace(split_part(pat, '-', 1), '[A-Z]', '', 'g') AS INT) AND CAST(split_part(pat, '-', 2) AS INT) ELSE num = pat END)
SELECT req, course_id, bool_or(role = 'in4' AND lo < 4 AND hi >= 4) AS limited, bool_or(role = 'out4' AND lo < 4 AND hi >= 4) AS narrowed FROM e GROUP BY req, course_id
HAVING bool_or(role = 'in' OR (role = 'in4' AND hi >= 4)) AND NOT bool_or(role = 'out' OR (role = 'out4' AND lo >= 4))
"""


@query("requirement_courses", _REQ_COURSES)
def requirement_courses(t):
    raw = raw_rows(t, "pattern").distinct()
    number = F.substring_index("pattern", " ", -1)
    four = F.array(F.struct(F.lit("").alias("connector"), F.lit("DWCREDITS").alias("code"),
                            F.lit(">=").alias("operator"), F.array(F.lit("4")).alias("values")))
    free = F.slice(four, 1, 0)
    prefix, wide = number.rlike(r"\w@$"), number.rlike(r"\w@@$")
    span = number.contains("-")
    includes = raw.where(~span & ~(prefix & ~wide)).withColumn("clauses", F.when(wide, four).otherwise(free))
    excludes = raw.where(span | (prefix & ~wide)).withColumn("clauses", F.when(span, four).otherwise(free))
    units = (role(t, "catalogue").select(
        F.concat(F.replace("department", F.lit(" "), F.lit("")), "course_number").alias("course_id"), "min_units", "max_units")
        .groupBy("course_id", "min_units").agg(F.max("max_units").alias("max_units")))
    catalogue = pattern_catalogue(t).distinct().join(units, "course_id")
    courses = programs.requirement_courses(includes, excludes, catalogue, ["req"], "20242025")
    return courses.select("req", "course_id", (F.size("any_of") > 0).alias("limited"), (F.size("all_of") > 0).alias("narrowed"))


@query("view_refresh", ORACLES["course_view"])
def view_refresh(t):
    from quadlake.sources import sinks
    from quadlake.streaming.snapshots import run_folder

    sinks.refresh_view(lambda: course_view(t), run_folder(t.spark, "views"), "course_view", "1")
    return t.spark.table("course_view")


@query("full_replace", """
SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
""")
def full_replace(t):
    from quadlake.sources import sinks
    from quadlake.streaming.snapshots import run_folder

    path = run_folder(t.spark, "orders")
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    sinks.replace_all(rows.where("o_orderstatus = 'F'"), path, ["year"])
    sinks.replace_all(rows, path, ["year"])
    return t.spark.read.schema("o_orderkey bigint, o_orderstatus string, year int").parquet(path)

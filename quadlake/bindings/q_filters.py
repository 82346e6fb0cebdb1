"""Filter queries over whole tables."""

from pyspark.sql import functions as F

from quadlake.bindings.registry import query
from quadlake.bindings.roles import DAY_FLAGS, FLAGS, RESTRICTIONS, cte, role
from quadlake.functions import filters as flt

AS_OF = "2024-01-20 12:00:00"


@query("scan_project", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 250000
""")
def scan_project(t):
    return (t.orders.where(F.col("o_totalprice") >= 250000)
            .select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("filter_conjuncts", f"""
{cte('staffed')}
SELECT section_key, line, quantity FROM staffed
WHERE flag = 'A' AND quantity >= 10 AND quantity <= 30 AND status = upper('o')
""")
def filter_conjuncts(t):
    where = flt.conjuncts(
        F.col("flag") == "A",
        flt.unit_bounds("quantity", "quantity", 10, 30),
        flt.eq_upper("status", "o"),
        flt.units_is("flag", None),
        flt.non_empty("flag"),
        flt.ilike_contains("flag", None),
    )
    return role(t, "staffed").where(where).select("section_key", "line", "quantity")


@query("filter_category_flags", f"""
{cte('catalogue')}
SELECT course_key, department FROM catalogue WHERE ge_3 OR ge_5a OR ge_8
""")
def filter_category_flags(t):
    where = flt.has_category(FLAGS, ["GE-3", "GE-5A", "GE-8"])
    return role(t, "catalogue").where(where).select("course_key", "department")


@query("filter_level_band", f"""
{cte('catalogue')}
SELECT course_key, course_numeric, 'offered' AS form FROM catalogue WHERE course_numeric BETWEEN 1 AND 99
UNION ALL
SELECT course_key, course_numeric, 'catalogue' FROM catalogue WHERE course_numeric >= 0 AND course_numeric < 100
UNION ALL
SELECT course_key, course_numeric, 'graduate' FROM catalogue WHERE course_numeric >= 200
""")
def filter_level_band(t):
    courses = role(t, "catalogue").select("course_key", "course_numeric")
    # One pass: the forms a row belongs to, then one row per form.
    forms = F.array(
        F.when(flt.level_band("course_numeric", "LowerDiv"), F.lit("offered")),
        F.when(flt.level_band("course_numeric", "LowerDiv", lower=0), F.lit("catalogue")),
        F.when(flt.level_band("course_numeric", "Graduate"), F.lit("graduate")),
    )
    return (courses.withColumn("form", F.explode(forms)).where(F.col("form").isNotNull()))


@query("filter_number_list", f"""
{cte('catalogue')}
SELECT course_key, course_number FROM catalogue
WHERE course_numeric = 45 OR course_number IN ('60B', 'H100') OR course_numeric BETWEEN 150 AND 170
""")
def filter_number_list(t):
    where = flt.number_list("course_numeric", "course_number", "45,60B,H100,150-170")
    return role(t, "catalogue").where(where).select("course_key", "course_number")


@query("filter_code_ranges", f"""
{cte('section')}
SELECT section_key, section_code FROM section
WHERE section_code IN (17, 4040) OR section_code BETWEEN 100 AND 900 OR section_code BETWEEN 8000 AND 9999
""")
def filter_code_ranges(t):
    where = flt.code_ranges("section_code", "17,100-900,4040,8000-9999")
    return role(t, "section").where(where).select("section_key", "section_code")


@query("filter_any_day", f"""
{cte('section')}
SELECT section_key FROM section WHERE meets_m OR meets_th OR meets_sa
""")
def filter_any_day(t):
    return role(t, "section").where(flt.any_day(DAY_FLAGS, "Mon,Thur,Sat")).select("section_key")


@query("filter_bounds", f"""
{cte('catalogue')}
SELECT course_key, min_units, max_units FROM catalogue WHERE min_units >= 2 AND max_units <= 4
""")
def filter_bounds(t):
    return (role(t, "catalogue").where(flt.unit_bounds("min_units", "max_units", 2, 4))
            .select("course_key", "min_units", "max_units"))


@query("filter_status_mode", f"""
{cte('section')}
SELECT section_key, m AS mode FROM section, (VALUES ('SkipFull'), ('SkipFullWaitlist'), ('FullOnly'), ('Overenrolled')) v(m)
WHERE CASE m WHEN 'SkipFull' THEN status <> 'FULL'
             WHEN 'SkipFullWaitlist' THEN status NOT IN ('FULL', 'Waitl')
             WHEN 'FullOnly' THEN status IN ('FULL', 'Waitl')
             ELSE enrolled > capacity OR total_enrolled > capacity END
""")
def filter_status_mode(t):
    modes = ["SkipFull", "SkipFullWaitlist", "FullOnly", "Overenrolled"]
    sections = role(t, "section").select("section_key", "status", "enrolled", "total_enrolled", "capacity")
    hits = F.array(*[
        F.when(flt.fill_status(m, "status", "enrolled", "total_enrolled", "capacity"), F.lit(m))
        for m in modes])
    return (sections.select("section_key", F.explode(hits).alias("mode"))
            .where(F.col("mode").isNotNull()))


@query("filter_tristate", """
SELECT mode, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem, (VALUES ('Exclude'), ('Include'), ('Only')) v(mode)
WHERE mode = 'Include' OR (mode = 'Only') = (l_returnflag = 'R' OR l_returnflag LIKE '%TBA%')
GROUP BY mode
""")
def filter_tristate(t):
    from quadlake.functions.project import impute_flag

    lines = t.lineitem.select("l_quantity", impute_flag("l_returnflag", ["R", "TBA"]).alias("cancelled"))
    hits = F.array(*[
        F.when(flt.conjuncts(flt.tristate("cancelled", m)), F.lit(m))
        for m in ("Exclude", "Include", "Only")])
    return (lines.withColumn("mode", F.explode(hits)).where(F.col("mode").isNotNull())
            .groupBy("mode")
            .agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")))


@query("filter_time_window", f"""
{cte('slot')}
SELECT slot_key, start_min, end_min FROM slot WHERE start_min >= 540 AND end_min <= 17 * 60 + 30
""")
def filter_time_window(t):
    return (role(t, "slot").where(flt.time_window("start_min", "end_min", "9:00am", "17:30"))
            .select("slot_key", F.col("start_min").cast("bigint").alias("start_min"),
                    F.col("end_min").cast("bigint").alias("end_min")))


@query("filter_exclude_codes", f"""
{cte('staffed')}
SELECT section_key, line FROM staffed WHERE NOT r_a AND NOT r_b AND NOT r_c AND NOT r_x
""")
def filter_exclude_codes(t):
    return (role(t, "staffed").where(flt.exclude_codes(RESTRICTIONS, ["A", "B", "C", "X"]))
            .select("section_key", "line"))


@query("filter_ilike", f"""
{cte('catalogue')}
SELECT course_key, title FROM catalogue WHERE title ILIKE '%WIDG%' OR title ILIKE 'sMaLl%'
""")
def filter_ilike(t):
    where = flt.any_of([flt.ilike_contains("title", "WIDG"), flt.ilike_prefix("title", "sMaLl")])
    return role(t, "catalogue").where(where).select("course_key", "title")


@query("filter_any_positive", f"""
{cte('mark')}, counted AS (
  SELECT course_key, day, count(*) FILTER (mark = 'signup') AS a, count(*) FILTER (mark = 'purchase') AS b,
         count(*) FILTER (mark = 'click') AS p FROM mark GROUP BY course_key, day)
SELECT course_key, CAST(day AS STRING) AS day, p FROM counted WHERE a > 0 OR b > 0
""")
def filter_any_positive(t):
    counted = role(t, "mark").groupBy("course_key", "day").agg(
        F.count_if(F.col("mark") == "signup").alias("a"),
        F.count_if(F.col("mark") == "purchase").alias("b"),
        F.count_if(F.col("mark") == "click").alias("p"))
    return (counted.where(flt.any_positive("a", "b"))
            .select("course_key", F.col("day").cast("string").alias("day"), "p"))


_ORDER = ("CASE term WHEN 'Fall' THEN 5 WHEN 'Summer2' THEN 4 WHEN 'Summer10wk' THEN 3 "
          "WHEN 'Summer1' THEN 2 WHEN 'Spring' THEN 1 ELSE 0 END")


@query("filter_term_range", f"""
{cte('section')}
SELECT section_key, year, term FROM section
WHERE (year > '1996' OR (year = '1996' AND {_ORDER} >= 2))
  AND (year < '1999' OR year = '1999')
""")
def filter_term_range(t):
    where = flt.term_between("year", "term", since=("1996", "Summer1"), until=("1999", None))
    return role(t, "section").where(where).select("section_key", "year", "term")


@query("filter_overlap_open", f"""
{cte('slot')}, s AS (SELECT slot_key, CAST(starts AS DATE) AS a,
  CASE WHEN slot_key % 4 <> 0 THEN CAST(ends AS DATE) END AS b FROM slot)
SELECT slot_key, 'bounded' AS form FROM s WHERE b IS NULL OR (a <= DATE '2024-01-15' AND b >= DATE '2024-01-10')
UNION ALL
SELECT slot_key, 'current' FROM s WHERE b IS NULL OR b >= DATE '2024-01-20'
""")
def filter_overlap_open(t):
    ranges = role(t, "slot").select(
        "slot_key", F.col("starts").cast("date").alias("a"),
        F.when(F.col("slot_key") % 4 != 0, F.col("ends").cast("date")).alias("b"))
    forms = F.array(
        F.when(flt.overlaps_open("a", "b", after="2024-01-10", before="2024-01-15"), F.lit("bounded")),
        F.when(flt.overlaps_open("a", "b", as_of="2024-01-20"), F.lit("current")))
    return (ranges.select("slot_key", F.explode(forms).alias("form"))
            .where(F.col("form").isNotNull()))


@query("filter_current_recent", f"""
{cte('slot')}, s AS (SELECT slot_key, starts, CASE WHEN slot_key % 3 <> 0 THEN ends END AS ends,
  starts - INTERVAL 1 DAY AS touched FROM slot)
SELECT slot_key, 'now' AS form FROM s
WHERE ends >= TIMESTAMP '2024-01-20 12:00:00'
   OR (ends IS NULL AND touched >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 14 DAY)
UNION ALL
SELECT slot_key, 'between' FROM s
WHERE starts >= TIMESTAMP '2024-01-05' AND starts < TIMESTAMP '2024-01-09'
""")
def filter_current_recent(t):
    rows = role(t, "slot").select(
        "slot_key", "starts",
        F.when(F.col("slot_key") % 3 != 0, F.col("ends")).alias("ends"),
        (F.col("starts") - F.expr("INTERVAL 1 DAY")).alias("touched"))
    forms = F.array(
        F.when(flt.current_or_recent("starts", "ends", "touched", AS_OF), F.lit("now")),
        F.when(flt.current_or_recent("starts", "ends", "touched", AS_OF,
                                     after="2024-01-05", before="2024-01-08"), F.lit("between")))
    return rows.select("slot_key", F.explode(forms).alias("form")).where(F.col("form").isNotNull())


@query("filter_umbrella", f"""
{cte('section')}
SELECT section_key, CASE WHEN term LIKE 'Summer%' THEN 'Summer' ELSE term END AS shown FROM section
WHERE term IN ('Summer1', 'Summer10wk', 'Summer2')
""")
def filter_umbrella(t):
    from quadlake.functions.project import collapse_term

    return (role(t, "section").where(F.col("term").isin(flt.expand_umbrella("Summer")))
            .select("section_key", collapse_term("term").alias("shown")))


@query("batch_lookup", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey IN (3, 5, 8, 13)
   OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING')
""")
def batch_lookup(t):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    few = [3, 5, 8, 13]
    wanted = (t.customer.where((F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING"))
              .select("c_custkey"))
    by_list = flt.lookup(t.orders, "o_orderkey", few).select(cols)
    rest = t.orders.where(~F.col("o_orderkey").isin(few))
    return by_list.unionByName(flt.lookup(rest, "o_custkey", wanted).select(cols))


@query("slot_overlap_filter", f"""
{cte('slot')}
SELECT room_key, slot_key, capacity FROM (
  SELECT *, CAST(room_key % 12 + 1 AS INT) AS capacity FROM slot) s
WHERE capacity BETWEEN 4 AND 8
  AND CAST(starts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-04', DATE '2024-01-21')
  AND ((hour(ends) * 60 + minute(ends) > 600 AND hour(starts) * 60 + minute(starts) < 720)
    OR (hour(ends) * 60 + minute(ends) > 900 AND hour(starts) * 60 + minute(starts) < 930))
""")
def slot_overlap_filter(t):
    from quadlake.operators.joins import slots_matching

    slots = role(t, "slot").select("slot_key", "room_key", "starts", "ends")
    rooms = (slots.select("room_key").distinct()
             .withColumn("capacity", (F.col("room_key") % 12 + 1).cast("int")))
    return slots_matching(
        rooms, slots, "room_key", "starts", "ends",
        dates=["2024-01-03", "2024-01-04", "2024-01-21"],
        ranges=[("10:00", "12:00"), ("15:00", "15:30")],
        room_filter=F.col("capacity").between(4, 8),
    ).select("room_key", "slot_key", "capacity")

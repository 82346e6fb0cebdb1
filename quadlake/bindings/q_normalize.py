"""Normalisation queries: raw texts built from the supplied tables, parsed by the jobs."""

from pyspark.sql import functions as F

from quadlake.bindings.raw_texts import raw_cte, raw_rows
from quadlake.bindings.registry import query
from quadlake.bindings.roles import cte, role
from quadlake.plans import calendar, catalogue, dining, listings

@query("normalize_meetings", f"""
WITH {raw_cte('meeting')},
p AS (SELECT *, time = 'TBA' AS tba, time LIKE '%p' AS pm,
  TRY_CAST(regexp_extract(time, '^([0-9]+):', 1) AS INT) % 12 * 60 + TRY_CAST(regexp_extract(time, '^[0-9]+:([0-9]+)', 1) AS INT) AS s,
  TRY_CAST(regexp_extract(time, '-([0-9]+):', 1) AS INT) % 12 * 60 + TRY_CAST(regexp_extract(time, '-[0-9]+:([0-9]+)', 1) AS INT) AS e FROM raw)
SELECT event_id, days IN ('MWF') AS monday, days IN ('TuTh', 'SuTh') AS thursday, days = 'TuTh' AS tuesday, days = 'Sa' AS saturday, days = 'SuTh' AS sunday,
  CASE WHEN tba THEN NULL WHEN pm AND s < e THEN s + 720 WHEN NOT pm AND s > e THEN s + 720 ELSE s END AS start_minute,
  CASE WHEN tba THEN NULL WHEN pm THEN e + 720 WHEN s > e THEN e + 1440 ELSE e END AS end_minute, tba AS time_is_tba FROM p
""")
def normalize_meetings(t):
    raw = raw_rows(t, "meeting")
    out = listings.normalize_meetings(raw)
    names = {"monday": "meets_m", "tuesday": "meets_tu", "thursday": "meets_th", "saturday": "meets_sa", "sunday": "meets_su"}
    return out.select("event_id", *[F.col(c).alias(n) for n, c in names.items()],
                      "start_minute", "end_minute", "time_is_tba")


@query("normalize_exams", f"""
WITH {raw_cte('exam')}, p AS (SELECT *, exam NOT IN ('', 'TBA') AS sched, exam LIKE '%pm%' AS pm,
  TRY_CAST(regexp_extract(exam, '([0-9]+):30-', 1) AS INT) % 12 * 60 + 30 AS s, TRY_CAST(regexp_extract(exam, '-([0-9]+):00', 1) AS INT) % 12 * 60 AS e,
  CASE WHEN exam NOT IN ('', 'TBA') THEN make_date(CAST(year AS INT), CASE WHEN exam LIKE '%Mar%' THEN 3 ELSE 12 END, TRY_CAST(split_part(exam, ' ', 3) AS INT)) END AS d FROM raw)
SELECT o_orderkey, CASE WHEN exam = '' THEN 'NO_FINAL' WHEN exam = 'TBA' THEN 'TBA_FINAL' ELSE 'SCHEDULED_FINAL' END AS status,
  strftime(d, '%a') AS day_of_week, CAST(month(d) - 1 AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
  CASE WHEN sched THEN CAST((CASE WHEN (pm AND s < e) OR (NOT pm AND s > e) THEN s + 720 ELSE s END) // 60 % 24 AS INTEGER) END AS start_hour,
  CASE WHEN sched THEN CAST((CASE WHEN pm THEN e + 720 WHEN s > e THEN e + 1440 ELSE e END) // 60 % 24 AS INTEGER) END AS end_hour,
  CASE WHEN NOT sched THEN NULL WHEN exam LIKE '%@%' THEN regexp_extract(exam, '@ (HALL [0-9]+)', 1) || '|LAB 2' ELSE room END AS buildings FROM p
""")
def normalize_exams(t):
    raw = raw_rows(t, "exam")
    out = listings.normalize_exams(raw, first_building="room")
    s = "exam_info.scheduled."
    return out.select(
        "o_orderkey", "exam_info.status", s + "day_of_week", s + "month", s + "day",
        F.col(s + "start_time.hour").alias("start_hour"), F.col(s + "end_time.hour").alias("end_hour"),
        F.array_join(s + "buildings", "|").alias("buildings"))


@query("normalize_counts", f"""
WITH {raw_cte('count')}
SELECT l_orderkey, l_partkey, CAST(section_code AS INTEGER) AS section_code, coalesce(TRY_CAST(regexp_extract(waitlist, '^(off \\()?\\s*([0-9]+)\\s*\\)?$', 2) AS INTEGER), -1) AS waitlist,
  coalesce(TRY_CAST(nullif(waitlist_cap, '') AS INTEGER), -1) AS waitlist_cap, -1 AS reserved, coalesce(TRY_CAST(section_enrolled AS INTEGER), -1) AS section_enrolled,
  coalesce(status, CASE WHEN coalesce(TRY_CAST(section_enrolled AS INTEGER), -1) >= CAST(max_capacity AS INTEGER) THEN 'FULL' ELSE 'OPEN' END) AS status,
  restrictions LIKE 'A and%' AS r_a, restrictions LIKE '% B %' AS r_b, restrictions LIKE 'A and B or X' AS r_x, restrictions LIKE '% or S' AS r_s
FROM raw
""")
def normalize_counts(t):
    raw = raw_rows(t, "count")
    out = listings.restriction_flags(listings.normalize_sections(raw))
    return out.select("l_orderkey", "l_partkey", "section_code", "waitlist", "waitlist_cap", "reserved",
                      "section_enrolled", "status", "r_a", "r_b", "r_x", "r_s")


_SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_NORM = _SQUEEZE.format(x="replace(replace(replace({x}, chr(160), ' '), chr(8239), ' '), chr(8230), '...')")


def _shown(column):
    """The text of a piece of a page in SQL: without tags, entities decoded."""
    out = f"regexp_replace({column}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


@query("catalogue_extract", f"""
WITH {raw_cte('block')}, shown AS (SELECT * REPLACE ({_shown('title')} AS title, {_shown('description')} AS description, {_shown('prerequisite_text')} AS prerequisite_text) FROM raw)
SELECT page_id, CASE WHEN page_id % 6 = 4 THEN 'rejected' ELSE 'course' END AS kind,
  'P&DX' || CASE WHEN page_id % 9 = 0 THEN 'H' ELSE '' END || (page_id % 290) || 'B' AS course_id, CAST(page_id % 290 AS INTEGER) AS course_numeric,
  CASE WHEN page_id % 290 < 100 THEN 'LowerDiv' WHEN page_id % 290 < 200 THEN 'UpperDiv' ELSE 'Graduate' END AS course_level,
  regexp_replace({_NORM.format(x='title')}, '\\.\\s*$', '') AS title, CAST(CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 1.3 END AS DOUBLE) AS min_units,
  CAST(CASE page_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE 1.3 END AS DOUBLE) AS max_units, md5({_NORM.format(x='description')}) AS description_md5,
  regexp_replace(regexp_extract({_NORM.format(x='prerequisite_text')}, '^Prerequisites:\\s*(.+)$', 1), '\\.\\s*$', '') AS prerequisite_text,
  page_id % 5 = 0 AS ge_2, page_id % 5 = 0 AS ge_5b, page_id % 5 = 1 AS ge_8, CASE page_id % 5 WHEN 0 THEN '(II, Vb ).' WHEN 1 THEN '(IIIa and VIII)' ELSE '' END AS ge_text,
  CASE page_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 12 WHEN 3 THEN 3 WHEN 5 THEN 0 END AS repeat_times,
  CASE page_id % 6 WHEN 0 THEN 'times' WHEN 1 THEN 'credit_hours' WHEN 3 THEN 'times' WHEN 5 THEN 'times' END AS repeat_unit
FROM shown WHERE page_id % 4 <> 3 AND {_NORM.format(x='title')} <> ''
""")
def catalogue_extract(t):
    def part(tag, css, column):
        return F.concat(F.lit(f'<{tag} class="text {css}">'), column, F.lit(f"</{tag}>"))

    # A catalogue page around the supplied texts: a block without a title, and the course's block.
    raw = raw_rows(t, "block")
    parts = [part("span", "detail-code", F.concat(F.lit("<strong>"), F.replace("code", F.lit("&"), F.lit("&amp;")), F.lit("</strong>"))),
             *[part(tag, css, F.col(c)) for tag, css, c in (
                 ("span", "detail-title", "title"), ("span", "detail-hours_html", "units"), ("div", "courseblockextra noindent", "description"),
                 ("p", "detail-prereqs", "prerequisite_text"), ("p", "detail-same_as", "same_as"), ("p", "detail-repeatability", "repeatability"),
                 ("p", "detail-gened", "ge_text"))]]
    html = F.concat(F.lit('<main><h1>Courses</h1><div class="courseblock"><span class="detail-code">P&amp;D X 1.</span><div class="courseblockextra">'
                          'none</div></div><div class="block courseblock">'), *parts, F.lit("</div><footer class='detail-title'>no</footer></main>"))
    blocks = catalogue.course_blocks(raw.select("page_id", "department", html.alias("html")), "page_id", "html")
    courses, rejected = catalogue.extract_catalogue(blocks)
    both = (courses.withColumn("kind", F.lit("course"))
            .unionByName(rejected.withColumn("kind", F.lit("rejected"))))
    return both.select(
        "page_id", "kind", "course_id", "course_numeric", "course_level", "title",
        F.col("min_units").cast("double").alias("min_units"), F.col("max_units").cast("double").alias("max_units"),
        F.md5("description").alias("description_md5"), "prerequisite_text", "ge_2", "ge_5b", "ge_8", "ge_text",
        "repeat_times", "repeat_unit")


@query("prereq_edges", f"""
WITH {raw_cte('prereq')}
SELECT p_partkey, 'ANDY' || p_partkey AS required_id FROM part
UNION SELECT p_partkey, 'B' || p_size FROM part UNION SELECT p_partkey, 'AP MUSIC' FROM part
UNION SELECT p_partkey, 'C D' || (p_size + 1) FROM part UNION SELECT p_partkey, 'E5' FROM part WHERE p_type <> 'PROMO'
""")
def prereq_edges(t):
    raw = raw_rows(t, "prereq")
    _, edges = catalogue.prereq_tables(raw, "p_partkey", "text")
    return edges


@query("alias_patch", """
WITH x AS (SELECT p_partkey, p_type, p_size FROM part)
SELECT p_partkey, 'F ' || p_size || ';' || CASE WHEN p_type = 'ECONOMY' THEN 'K 32A|K H32' WHEN p_type = 'PROMO' THEN 'G 1|K H32|K 32A'
  WHEN p_size < 25 THEN 'K 32A|G 2|K H32' ELSE 'G 3|G 4' END AS groups FROM x
""")
def alias_patch(t):
    group = (F.when(F.col("p_type") == "ECONOMY", "( K 32A OR K H32 )").when(F.col("p_type") == "PROMO", "( G 1 OR K H32 )")
             .when(F.col("p_size") < 25, "( K 32A OR G 2 )").otherwise("( G 3 OR G 4 )"))
    raw = t.part.select("p_partkey", F.concat(F.lit("F "), F.col("p_size").cast("string"), F.lit(" AND "), group).alias("text"))
    trees, _ = catalogue.prereq_tables(raw, "p_partkey", "text")
    patched = catalogue.patch_alias(trees, "K 32A", "K H32")
    shown = F.transform("groups", lambda g: F.array_join(F.transform(g, lambda x: x["name"]), "|"))
    return patched.select("p_partkey", F.array_join(shown, ";").alias("groups"))


@query("calendar_lines", f"""
{cte('place')}, y AS (SELECT place_key AS key, c_nationkey AS n, 2000 + c_nationkey AS y FROM place),
t AS (SELECT key, n, y, i, q FROM y, (VALUES (0, 'Fall'), (1, 'Winter'), (2, 'Spring'), (3, 'Summer1'), (4, 'Summer10wk'), (5, 'Summer2')) v(i, q))
SELECT key, CAST(y + CAST(i > 0 AS INT) AS VARCHAR) AS year, q AS quarter,
  CAST(make_date(CAST(y + CAST(i > 0 AS INT) AS INT), CAST([9, 1, 4, 6, 7, 8][i + 1] AS INT), CAST(n + 1 AS INT)) AS VARCHAR) AS instruction_start,
  CAST(make_date(CAST(y + CAST(i > 0 AS INT) AS INT), CAST([12, 3, 6, 7, 8, 9][i + 1] AS INT), 5) AS VARCHAR) AS instruction_end,
  CAST(make_date(CAST(y + CAST(i > 0 AS INT) AS INT), CAST([12, 3, 6, 7, 8, 9][i + 1] AS INT), CASE WHEN i < 3 THEN 6 ELSE 8 END) AS VARCHAR) AS finals_start,
  CAST(CASE WHEN i = 1 THEN make_date(CAST(y + 1 AS INT), 4, 2) ELSE make_date(CAST(y + CAST(i > 0 AS INT) AS INT), CAST([12, 3, 6, 7, 8, 9][i + 1] AS INT), CASE WHEN i < 3 THEN 12 ELSE 8 END) END AS VARCHAR) AS finals_end,
  CAST(make_date(CAST(y + CAST(i > 1 AS INT) AS INT), CAST([4, 11, 2, 3, 3, 3][i + 1] AS INT), 20) AS VARCHAR) AS soc_available
FROM t
""")
def calendar_lines(t):
    day = (F.col("c_nationkey") + 1).cast("string")

    def cells(*parts):
        return F.concat(*[x for p in parts for x in (F.lit("\n  "), p if not isinstance(p, str) else F.lit(p))], F.lit("\n"))

    def months(*names):
        return [F.concat(F.lit(m + " "), day) for m in names]

    text = F.concat(
        F.lit("Quarterly calendar\nSchedule of Classes available"), cells("Apr 20", "Nov 20", "Feb 20"),
        F.lit("Instruction begins"), cells(*months("Sep", "Jan", "Apr")), F.lit("\n Instruction ends"), cells("Dec 5", "Mar 5", "Jun 5"),
        F.lit("Final Examinations"), cells("Dec 6-12", "Mar 6–Apr 2", "Jun 6–12"), F.lit("Summer\nSchedule of Classes Available"),
        cells("Mar 20", "Mar 20", "Mar 20"), F.lit("Instruction Begins"), cells(*months("Jun", "Jul", "Aug")),
        F.lit("Instruction Ends"), cells("Jul 5", "Aug 5", "Sep 5"), F.lit("Final examinations"), cells("Jul 8", "Aug 8", "Sep 8"))
    pages = role(t, "place").select(F.col("place_key").alias("key"), (F.col("c_nationkey") + 2000).alias("y"), text.alias("text"))
    terms = calendar.calendar_terms(pages, "key", "y", "text")
    dates = ["instruction_start", "instruction_end", "finals_start", "finals_end", "soc_available"]
    return terms.select("key", "year", "quarter", *[F.col(d).cast("string").alias(d) for d in dates])


@query("expand_hours", f"""
{cte('place')}
SELECT place_key, CASE WHEN area = 0 THEN '09:00' WHEN area = 2 THEN '10:00' END AS open_su,
  CASE WHEN area < 2 THEN '07:15' WHEN area = 2 THEN '10:00' WHEN area = 3 THEN '08:00' END AS open_mo,
  CASE WHEN area = 0 THEN '11:00' WHEN area = 1 THEN CAST(12 + c_nationkey % 10 AS VARCHAR) || ':00' END AS close_we,
  CASE WHEN area < 2 THEN '07:15' WHEN area = 2 THEN '10:00' END AS open_fr,
  CASE WHEN area = 0 THEN '12:00' WHEN area = 2 THEN '14:00' END AS close_sa
FROM place
""")
def expand_hours(t):
    close = F.concat((F.col("c_nationkey") % 10 + 12).cast("string"), F.lit(":00"))
    text = (F.when(F.col("area") == 0, F.lit("Mo-Fr 07:15-11:00; Sa-Su 09:00-12:00"))
            .when(F.col("area") == 1, F.concat(F.lit("Mo-Fr  07:15-11:00;We 12:00-"), close, F.lit("; Xx 1:00-2:00")))
            .when(F.col("area") == 2, F.lit("Fr-Mo 10:00-14:00; Tu"))
            .when(F.col("area") == 3, F.lit("Mo-Th 08:00-9:00; Tu-Th off")).otherwise(F.lit("")))
    hours = dining.expand_hours(role(t, "place").select("place_key", text.alias("hours")), "hours")
    return hours.select("place_key", "open_su", "open_mo", "close_we", "open_fr", "close_sa")


CODES = {"has_milk": 3, "has_nuts": 7, "is_vegan": 12}


@query("attributes_pivot", """
SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, CASE WHEN p_size > 25 THEN 'Big ' || p_type ELSE '' END AS description,
  CAST(p_size AS DOUBLE) AS calories, CASE WHEN p_size > 25 THEN NULL ELSE CAST(p_size % 7 AS DOUBLE) END AS sodium_mg, '2' AS serving_size, 'cups' AS serving_unit,
  p_size % 13 = 3 AS has_milk, p_size % 13 = 7 OR p_type = 'PROMO' AS has_nuts, p_size % 13 = 12 OR p_type = 'PROMO' AS is_vegan,
  CASE WHEN p_type = 'ECONOMY' THEN 'http://img.example.org/' || p_partkey END AS image_url
FROM part
""")
def attributes_pivot(t):
    def attr(name, *vals):
        return F.struct(F.lit(name).alias("name"), F.array(*vals).alias("values"))

    size = F.col("p_size").cast("string")
    sodium = F.when(F.col("p_size") > 25, F.lit("unknown")).otherwise((F.col("p_size") % 7).cast("string"))
    prefs = F.when(F.col("p_type") == "PROMO", F.array(F.lit("12"), F.lit("7"))).otherwise(F.array(F.lit("40")))
    attributes = F.array_compact(F.array(
        attr("calories", size), attr("sodium", sodium), attr("serving_combined", F.lit("2 cups")),
        attr("allergens_intolerances", (F.col("p_size") % 13).cast("string"), F.lit(" 44")),
        F.struct(F.lit("recipe_attributes").alias("name"), prefs.alias("values")),
        F.when(F.col("p_size") > 25, attr("marketing_description", F.concat(F.lit("Big "), "p_type")))))
    image = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit(" http://img.example.org/"), F.col("p_partkey").cast("string")))
    sku = F.col("p_partkey").cast("string").alias("sku")
    products = t.part.select(F.col("p_partkey").alias("pos"), sku, F.col("p_name").alias("name"),
                             F.array(F.coalesce(image, F.lit(" "))).alias("images"), attributes.alias("attributes"))
    date_map = t.part.select(F.lit("2024-01-0").alias("date"), F.array(F.struct(
        F.col("p_size").alias("id"), F.array(sku).alias("skus"))).alias("stations"))
    tables = dining.menu_tables(products, date_map, CODES)
    dish = tables["dish"].select("sku", "name", "description", "image_url")
    nutrition = tables["nutrition"].select("sku", "calories", "sodium_mg", "serving_size", "serving_unit")
    return dish.join(nutrition, "sku").join(tables["diet"], "sku")


@query("events_localize", """
WITH raw AS (SELECT event_id, user_id, event_type || '-' || (user_id % 9) AS title, CASE WHEN event_type <> 'error' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS sd,
   strftime(ts, '%H:%M:%S') AS st, CASE WHEN value > 50 THEN strftime(ts, '%H:59:59') END AS et FROM events),
u AS (SELECT *, timezone('UTC', timezone('America/Los_Angeles', CAST(sd || ' ' || st AS TIMESTAMP))) AS s, timezone('UTC', timezone('America/Los_Angeles', CAST(sd || ' ' || et AS TIMESTAMP))) AS e FROM raw),
k AS (SELECT *, CASE WHEN s IS NULL THEN title ELSE CAST(s AS VARCHAR) || coalesce(CAST(e AS VARCHAR), '') END AS k FROM u)
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(title, event_id) AS title, strftime(arg_max(s, event_id), '%Y-%m-%d %H:%M:%S') AS starts,
  strftime(CASE WHEN max(event_id) = max(event_id) FILTER (e IS NOT NULL) THEN arg_max(e, event_id) END, '%Y-%m-%d %H:%M:%S') AS ends,
  CASE WHEN arg_max(title, event_id) LIKE 'view%' THEN 'img-' || arg_max(title, event_id) END AS image
FROM k GROUP BY user_id, k
""")
def events_localize(t):
    title = F.concat_ws("-", "event_type", (F.col("user_id") % 9).cast("string"))
    clock = F.date_format("ts", "HH:mm:ss")
    raw = t.events.select(
        F.col("user_id").alias("place"), F.col("event_id").alias("pos"), title.alias("title"),
        F.when(F.col("event_type") != "error", F.col("ts").cast("date").cast("string")).alias("start_date"),
        clock.alias("start_time"), F.lit(None).cast("string").alias("end_date"),
        F.when(F.col("value") > 50, F.concat(F.date_format("ts", "HH"), F.lit(":59:59"))).alias("end_time"))
    images = (t.events.where("event_type = 'view'").select(title.alias("title"), F.col("event_id").alias("image_pos"))
              .withColumn("url", F.concat(F.lit("/"), F.repeat(F.lit("x"), F.lit(34)), F.lit("/"), "title", F.lit("/as/picture/large.png"))))
    images = images.withColumn("image", dining.image_address("url", "img-"))
    out = dining.localize_events(raw, images, "America/Los_Angeles")
    return out.select(
        F.col("place").alias("user_id"), F.col("pos").alias("event_id"), "title",
        F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"),
        F.date_format("ends", "yyyy-MM-dd HH:mm:ss").alias("ends"), "image")

"""Table maintenance queries: stored rows against incoming rows."""

from pyspark.sql import functions as F

from quadlake.bindings.registry import query
from quadlake.bindings.roles import FLAGS, cte, role
from quadlake.operators import upsert

# Stored: each user's last large event before the 15th; incoming: the last since the 10th.
_SIDES = """WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(floor(value), (ts, event_id)) AS value, true AS flagged
  FROM events WHERE ts < TIMESTAMP '2024-01-15' AND value > 150 GROUP BY 1),
n AS (SELECT user_id, nullif(arg_max(event_type, (ts, event_id)), 'error') AS kind,
  nullif(arg_max(floor(value), (ts, event_id)), 3) AS value, false AS flagged
  FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value > 150 GROUP BY 1)"""


def sides(t):
    def newest(df):
        return upsert.last_wins(df.select("user_id", "event_type", "value", "ts", "event_id"),
                                ["user_id"], ["ts", "event_id"])

    old = newest(t.events.where("ts < TIMESTAMP_NTZ '2024-01-15' AND value > 150")).select(
        "user_id", F.col("event_type").alias("kind"), F.floor("value").cast("double").alias("value"),
        F.lit(True).alias("flagged"))
    new = newest(t.events.where("ts >= TIMESTAMP_NTZ '2024-01-10' AND value > 150")).select(
        "user_id", F.nullif("event_type", F.lit("error")).alias("kind"),
        F.nullif(F.floor("value").cast("double"), F.lit(3.0)).alias("value"), F.lit(False).alias("flagged"))
    return old, new


@query("merge_coalesce", f"""
{_SIDES}
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.value, o.value) AS value,
  coalesce(n.flagged, o.flagged) AS flagged FROM o FULL JOIN n ON o.user_id = n.user_id
""")
def merge_coalesce(t):
    old, new = sides(t)
    return upsert.merge_coalesce(old, new, ["user_id"])


@query("merge_keep_cols", f"""
{_SIDES}
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.value, o.value) AS value,
  CASE WHEN o.user_id IS NOT NULL THEN o.flagged ELSE n.flagged END AS flagged FROM o FULL JOIN n ON o.user_id = n.user_id
""")
def merge_keep_cols(t):
    old, new = sides(t)
    return upsert.merge_coalesce(old, new, ["user_id"], keep_old=["flagged"])


@query("insert_if_absent", f"""
{_SIDES}
SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)
""")
def insert_if_absent(t):
    old, new = sides(t)
    return upsert.insert_if_absent(old, new, ["user_id"])


@query("replace_by_key", """
WITH touched AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT l_orderkey, l_partkey, l_linenumber, 'old' AS origin FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM touched)
UNION ALL
SELECT l_orderkey, l_partkey, l_linenumber, 'new' FROM lineitem WHERE l_linenumber < 3 AND l_orderkey IN (SELECT o_orderkey FROM touched)
""")
def replace_by_key(t):
    touched = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    old = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.lit("old").alias("origin"))
    new = (old.where("l_linenumber < 3").withColumn("origin", F.lit("new"))
           .join(touched, "l_orderkey", "left_semi"))
    return upsert.replace_by_key(old, new, touched, ["l_orderkey"])


@query("orphan_sweep", """
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)
""")
def orphan_sweep(t):
    refs = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return upsert.orphan_sweep(t.part.select("p_partkey", "p_name"), refs, "p_partkey")


@query("retention_trim", """
SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2025-04-12 06:00:00' - INTERVAL 15 MONTH
""")
def retention_trim(t):
    return upsert.retention_trim(t.events, "ts", "2025-04-12 06:00:00").select("event_id", "user_id")


_OK = ["GE-1A", "GE-2", "GE-8"]


@query("flag_reset_set", f"""
{cte('catalogue')}, hits AS (SELECT DISTINCT department, course_number, title, c.code FROM catalogue,
  (VALUES ('GE-1A', 3), ('GE-2', 4), ('GE-3', 5)) c(code, k) WHERE course_key % k = 0),
s AS (SELECT department, course_number, title, bool_or(code = 'GE-1A') AS a, bool_or(code = 'GE-2') AS b FROM hits GROUP BY 1, 2, 3)
SELECT course_key, coalesce(a, false) AS ge_1a, coalesce(b, false) AS ge_2, ge_3, false AS ge_8
FROM catalogue LEFT JOIN s USING (department, course_number, title)
""")
def flag_reset_set(t):
    keys = ["department", "course_number", "title"]
    courses = role(t, "catalogue").select("course_key", *keys, *FLAGS.values())
    found = F.array(*[
        F.when(F.col("course_key") % k == 0, F.lit(code)) for code, k in (("GE-1A", 3), ("GE-2", 4), ("GE-3", 5))])
    hits = courses.select(*keys, F.explode(F.array_compact(found)).alias("category"))
    return (upsert.flag_reset_set(courses, hits, keys, FLAGS, _OK)
            .select("course_key", "ge_1a", "ge_2", "ge_3", "ge_8"))

"""Paging, sorting, newest-per-key and chunk queries; unions and diffs."""

from pyspark.sql import functions as F

from quadlake.bindings.registry import query
from quadlake.bindings.roles import cte, role
from quadlake.operators import diff, paging

_ORDER = ("CASE term WHEN 'Fall' THEN 5 WHEN 'Summer2' THEN 4 WHEN 'Summer10wk' THEN 3 "
          "WHEN 'Summer1' THEN 2 WHEN 'Spring' THEN 1 ELSE 0 END")


@query("page_offset", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 100 OFFSET 200
""")
def page_offset(t):
    rows = t.orders.where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus")
    return paging.page(rows, "o_orderkey", skip=200, take=100)


@query("page_cursor", """
(SELECT 'item' AS kind, o_orderkey AS key FROM orders WHERE o_orderkey >= 4000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50)
UNION ALL
(SELECT 'next', o_orderkey FROM orders WHERE o_orderkey >= 4000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1 OFFSET 50)
""")
def page_cursor(t):
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    items, following = paging.page_after(rows, "o_orderkey", cursor=4000, take=50)
    return diff.union_tagged({
        "item": items.select(F.col("o_orderkey").alias("key")),
        "next": following.select(F.col("next_cursor").alias("key"))})


@query("chunk_bounds", f"""
{cte('section')}, r AS (SELECT year, term, section_code, row_number() OVER (PARTITION BY year, term ORDER BY section_code) AS rn FROM section),
b AS (SELECT year, term, CAST(rn // 100 AS BIGINT) AS chunk, CAST(section_code AS BIGINT) AS upper_code FROM r WHERE rn % 100 = 0),
c AS (SELECT year, term, chunk, coalesce(lag(upper_code) OVER (PARTITION BY year, term ORDER BY chunk) + 1, 1) AS lower_code, upper_code FROM b)
SELECT * FROM c UNION ALL
SELECT s.year, s.term, coalesce(max(chunk), 0) + 1, coalesce(max(upper_code), 0) + 1, 97999
FROM (SELECT DISTINCT year, term FROM section) s LEFT JOIN b ON b.year = s.year AND b.term = s.term GROUP BY 1, 2
""")
def chunk_bounds(t):
    return paging.chunk_bounds(role(t, "section"), ["year", "term"], "section_code", n=100)


@query("distinct_on_latest", """
SELECT o_custkey, arg_max(o_orderstatus, (year(o_orderdate), o_orderkey)) AS o_orderstatus, max(CAST(year(o_orderdate) AS BIGINT)) AS year
FROM orders GROUP BY o_custkey
""")
def distinct_on_latest(t):
    years = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus",
                            F.year("o_orderdate").cast("bigint").alias("year"))
    newest = paging.distinct_on(years, ["o_custkey"], F.struct("year", "o_orderkey"))
    return newest.select("o_custkey", "o_orderstatus", "year")


@query("terms_sorted", f"""
{cte('section')}, d AS (SELECT DISTINCT year, term FROM section)
SELECT year, term, CAST(row_number() OVER (ORDER BY year DESC, {_ORDER} DESC) AS BIGINT) AS place FROM d
""")
def terms_sorted(t):
    # The term list itself is tiny; its place makes the order visible in the result.
    ordered = paging.order_terms(role(t, "section"), "year", "term")
    listed = ordered.agg(F.array_sort(
        F.collect_list(F.struct("year", "term")), _later_first).alias("l"))
    return (listed.select(F.posexplode("l").alias("place", "x"))
            .select("x.year", "x.term", (F.col("place") + 1).cast("bigint").alias("place")))


def _later_first(a, b):
    from quadlake.functions.filters import term_ordinal

    def rank(x):
        return x["year"].cast("int") * 10 + term_ordinal(x["term"])

    return (rank(b) - rank(a)).cast("int")


@query("sort_nulls", """
SELECT o_orderkey, o_orderpriority FROM (
  SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority, o_orderstatus FROM orders)
ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END, o_orderpriority ASC NULLS FIRST, o_orderkey
""")
def sort_nulls(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus",
                           F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("o_orderpriority"))
    first = F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    ordered = paging.order_nulls(rows, first, F.col("o_orderpriority").asc_nulls_first(), F.col("o_orderkey"))
    return ordered.select("o_orderkey", "o_orderpriority")


@query("stalest_first", """
WITH terms AS (SELECT o_custkey AS name, min(o_orderdate) AS opens, max(o_orderdate) AS closes FROM orders GROUP BY 1),
runs AS (SELECT user_id AS name, max(ts) AS last_run FROM events GROUP BY 1)
SELECT name, strftime(coalesce(last_run, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS last_run
FROM terms LEFT JOIN runs USING (name)
WHERE opens <= TIMESTAMP '1998-01-01' AND closes >= TIMESTAMP '1998-01-01' ORDER BY coalesce(last_run, TIMESTAMP '1970-01-01'), name LIMIT 20
""")
def stalest_first(t):
    terms = t.orders.groupBy(F.col("o_custkey").alias("name")).agg(
        F.min("o_orderdate").alias("opens"), F.max("o_orderdate").alias("closes"))
    runs = t.events.groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("last_run"))
    picked = paging.stalest_first(terms, runs, "name", "last_run", "opens", "closes",
                                  "1998-01-01 00:00:00", take=20)
    return picked.select("name", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query("union_tagged", """
SELECT 'course' AS kind, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT 'instructor', s_suppkey, s_name FROM supplier
""")
def union_tagged(t):
    return diff.union_tagged({
        "course": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        "instructor": t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))})


@query("snapshot_diff", """
WITH o AS (SELECT * FROM customer WHERE c_acctbal > -500),
n AS (SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' OR c_acctbal > 0 THEN c_name END AS c_name,
      CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey // 2 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 9000),
j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_custkey AS ok, n.c_custkey AS nk,
  o.c_name AS o1, n.c_name AS n1, CAST(o.c_nationkey AS VARCHAR) AS o2, CAST(n.c_nationkey AS VARCHAR) AS n2 FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
SELECT c_custkey, 'added' AS change, NULL AS "column", NULL AS old, NULL AS new FROM j WHERE ok IS NULL
UNION ALL SELECT c_custkey, 'removed', NULL, NULL, NULL FROM j WHERE nk IS NULL
UNION ALL SELECT c_custkey, 'changed', 'c_name', o1, n1 FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND o1 IS DISTINCT FROM n1
UNION ALL SELECT c_custkey, 'changed', 'c_nationkey', o2, n2 FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND o2 IS DISTINCT FROM n2
""")
def snapshot_diff(t):
    old = t.customer.where("c_acctbal > -500")
    named = (F.col("c_mktsegment") != "MACHINERY") | (F.col("c_acctbal") > 0)
    moved = F.floor(F.col("c_nationkey") / 2).cast("int")
    new = t.customer.where("c_acctbal < 9000").withColumns({
        "c_name": F.when(named, F.col("c_name")),
        "c_nationkey": F.when(F.col("c_mktsegment") == "BUILDING", moved).otherwise(F.col("c_nationkey"))})
    return diff.snapshot_diff(old, new, ["c_custkey"], ignore=["c_acctbal"])


@query("distinct_pairs", """
SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders
""")
def distinct_pairs(t):
    return diff.distinct_cols(t.orders, ["o_orderstatus", "o_orderpriority"])

import random

import pytest
from pyspark.sql import functions as F

from quadlake.operators import aggs, diff, joins, paging, search, slices, upsert
from quadlake.plans import views


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; several rows share an order value."""
    rnd = random.Random(7)
    data = [(0 if i % 3 else rnd.randrange(5), rnd.randrange(40) * 10, i) for i in range(900)]
    return spark.createDataFrame(data, "k int, o long, id long"), data


def test_positions_match_a_plain_sort(skewed, rows):
    df, data = skewed
    got = {(k, i): p for k, _, i, p in rows(slices.with_position(df, ["k"], ["o", "id"], slices.id_block("o", 50)))}
    for key in {k for k, _, _ in data}:
        ordered = sorted((o, i) for k, o, i in data if k == key)
        assert [got[(key, i)] for _, i in ordered] == list(range(1, len(ordered) + 1))


def test_positions_keep_null_keys_and_no_keys(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o long")
    assert rows(slices.with_position(df, ["k"], ["o"], slices.id_block("o", 1))) == [("a", 1, 1), (None, 1, 1), (None, 2, 2)]
    assert [r.pos for r in slices.with_position(df, [], ["o", "k"], slices.id_block("o", 1)).orderBy("pos").collect()] == [1, 2, 3]


def test_null_order_values_come_first(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", 0), ("a", -5), ("a", 70), (None, None), (None, 9), ("", 1)], "k string, o long")
    assert rows(slices.with_position(df, ["k"], ["o"], slices.id_block("o", 10)), "k", "o", "pos") == sorted(
        [("a", None, 1), ("a", -5, 2), ("a", 0, 3), ("a", 70, 4), (None, None, 1), (None, 9, 2), ("", 1, 1)], key=repr)


def test_rows_move_once_for_a_position(spark):
    df = spark.range(100).selectExpr("id % 7 AS k", "id AS o")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = slices.with_position(df, ["k"], ["o"], slices.id_block("o"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for the rows; the other three belong to the small table of slice sizes.
    assert plan.count("Exchange hashpartitioning") == 4


def test_pages_hold_everything_in_order(skewed):
    df, data = skewed
    pages = slices.paged_lists(df, ["k"], ["o", "id"], slices.id_block("o", 50), F.col("id"), "ids", 7).collect()
    assert max(len(p.ids) for p in pages) == 7
    for key in {k for k, _, _ in data}:
        joined = [i for p in sorted((p for p in pages if p.k == key), key=lambda p: p.page) for i in p.ids]
        assert joined == [i for _, i in sorted((o, i) for k, o, i in data if k == key)]


def test_carry_forward(spark):
    rnd = random.Random(3)
    data = [(i % 2, i, rnd.choice([None, None, None, f"h{i}"])) for i in range(200)]
    df = spark.createDataFrame(data, "k int, p long, h string")
    got = {(r.k, r.p): r.x for r in slices.carry_forward(df, ["k"], ["p"], slices.id_block("p", 8), "h", "x").collect()}
    last = {0: None, 1: None}
    for k, p, h in data:
        last[k] = h or last[k]
        assert got[(k, p)] == last[k]


def test_semi_join_equals_join_and_distinct(spark, rows):
    entity = spark.createDataFrame([(i,) for i in range(20)], "id int")
    bridge = spark.createDataFrame([(i % 10, i) for i in range(60)], "id int, v int")
    semi = joins.filter_via_bridge(entity, bridge, F.col("v") > 33, "id")
    naive = entity.join(bridge, "id", "left").where("v > 33").select("id").distinct()
    assert rows(semi) == rows(naive)


@pytest.mark.parametrize("years,asked,best", [
    (["20222023", "20242025"], "20232024", "20242025"),
    (["20202021", "20242025"], "20212022", "20202021"),
    (["20202021", "20232024"], "20232024", "20232024"),
])
def test_nearest_year(spark, rows, years, asked, best):
    df = spark.createDataFrame([("m", y) for y in years], "id string, y string")
    assert rows(joins.nearest_year(df, ["id"], "y", asked)) == [("m", best)]
    assert rows(joins.nearest_year(df, [], "y", asked, is_global=True)) == [("m", best)]


def test_null_safe_join(spark, rows):
    a = spark.createDataFrame([(1, None), (1, "x")], "m int, s string")
    b = spark.createDataFrame([(1, None, 7), (1, "y", 8)], "m int, s string, r int")
    assert rows(joins.join_null_safe(a, b, ["m"], ["s"])) == [(1, None, 7)]


def test_rooms_without_matching_slot_vanish(spark, rows):
    rooms = spark.createDataFrame([("a", 4), ("b", 4)], "room string, cap int")
    slots = spark.sql("SELECT 'a' room, TIMESTAMP_NTZ '2024-01-01 10:00:00' s, TIMESTAMP_NTZ '2024-01-01 11:00:00' e")
    hit = joins.slots_matching(rooms, slots, "room", "s", "e", ranges=[("10:30", "12:00")])
    assert rows(hit, "room") == [("a",)]
    assert rows(joins.slots_matching(rooms, slots, "room", "s", "e", ranges=[("11:00", "12:00")]), "room") == []
    assert rows(joins.slots_matching(rooms, slots, "room", "s", "e"), "room") == [("a",), ("b",)]


def test_interval_join_keeps_unmatched_on_left(spark, rows):
    days = spark.sql("SELECT DATE '2024-01-03' d UNION ALL SELECT DATE '2024-03-01'")
    spans = spark.sql("SELECT 'w' n, DATE '2024-01-01' lo, DATE '2024-01-31' hi")
    assert [r[1] for r in rows(joins.interval_contains(days, spans, "d", "lo", "hi", "left"), "d", "n")] == ["w", None]


def test_totals_equal_sum_of_groups_and_empty_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 2, 3.0), ("a", 3, 4, None), ("b", 5, 6, 1.0)], "d string, x long, y long, g double")
    total, members = aggs.dist_total(df, ["x", "y"], "g", ["d"])
    groups = aggs.dist_by(df, ["d"], ["x", "y"], "g").agg(F.sum("x"), F.sum("y")).first()
    assert tuple(total.first()) == (9, 12, 2.0) and tuple(groups) == (9, 12) and members.count() == 3
    none, _ = aggs.dist_total(df.where("d = 'z'"), ["x", "y"], "g", ["d"])
    assert tuple(none.first()) == (0, 0, None)


def test_fanout_only_on_request(spark):
    sections = spark.createDataFrame([(1, "d", 10, 3.0)], "s int, d string, x long, g double")
    bridge = spark.createDataFrame([(1, "p"), (1, "q")], "s int, who string")
    once = aggs.dist_by(sections, ["d"], ["x"], "g", bridge, ["s"]).first()
    twice = aggs.dist_by(sections, ["d"], ["x"], "g", bridge, ["s"], compat_fanout=True).first()
    assert once.x == 10 and twice.x == 20


def test_group_intersection_rules(spark, rows):
    sections = spark.createDataFrame(
        [("L", "c", "A"), ("D1", "c", "A1"), ("M", "c", "B"), ("N", "d", "1"), ("O", "d", "2"), ("P", "e", "1")],
        "s string, c string, n string")
    bridge = spark.createDataFrame(
        [("L", "prof"), ("D1", "prof"), ("D1", "ta"), ("M", "other"), ("N", "x"), ("O", "y"), ("P", "z")], "s string, who string")
    assert rows(aggs.group_intersection(sections, bridge, "s", "c", "n", "who")) == [
        ("D1", "prof"), ("L", "prof"), ("M", "other"), ("N", "x"), ("O", "y"), ("P", "z")]


def test_group_intersection_with_nulls_and_gaps(spark, rows):
    sections = spark.createDataFrame([("a", "c", "A"), ("b", "c", "A2"), ("n", None, "1"), ("u", "c", "Z"), ("r", "d", "1"), ("r", "d", "1")],
                                     "s string, c string, n string")
    bridge = spark.createDataFrame([("a", None), ("a", "x"), ("b", None), ("n", "own"), ("r", "y"), ("r", "y")], "s string, who string")
    assert rows(aggs.group_intersection(sections, bridge, "s", "c", "n", "who"), "s", "who") == [
        ("a", None), ("b", None), ("n", "own"), ("r", "y"), ("r", "y")]


def test_group_intersection_moves_the_bridge_once(spark):
    sections = spark.range(500).selectExpr("id s", "id div 7 c", "cast(id % 3 as string) n")
    bridge = spark.range(900).selectExpr("id % 500 s", "id % 4 who")
    joins_off = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = aggs.group_intersection(sections, bridge, "s", "c", "n", "who")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins_off)
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert plan.count("Range (0, 900") == 1 and "ReusedExchange" in plan
    # By course: the counts, their comparison, and the sections that take what is shared.
    assert sum("hashpartitioning(c#" in line for line in moves) == 3


def _slices_of(df, keys):
    return df.groupBy(*keys, "_slice").count().agg(F.max("count"), F.count("*")).first()


@pytest.mark.parametrize("key", ["id", "id * 1000003", "xxhash64(id)", "concat('department of the same name ', id)",
                                 "if(id % 50 = 0, null, lpad(id, 40, 'x'))"])
def test_ranges_are_bounded_for_keys_of_any_kind(spark, key):
    df = spark.range(0, 20000, numPartitions=4).selectExpr("if(id % 3 < 2, 0, id % 11) k", f"{key} o", "id")
    cut = slices.ranged(df, ["k"], ["o", "id"], 1000)
    biggest, some = _slices_of(cut, ["k"])
    assert cut.count() == 20000 and biggest <= 2500 and some >= 20
    got = {(r.k, r.id): r.pos for r in slices.with_position(df, ["k"], ["o", "id"], None).collect()}
    sliced = {(r.k, r.id): r.pos for r in slices.with_position(cut, ["k"], ["o", "id"], F.col("_slice")).collect()}
    want, last = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.o is not None, r.o if r.o is not None else 0, r.id)):
        last[r.k] = last.get(r.k, 0) + 1
        want[r.k, r.id] = last[r.k]
    assert got == want and sliced == want


def test_ranges_of_nothing(spark):
    assert slices.ranged(spark.createDataFrame([], "k int, o string"), ["k"], ["o"]).count() == 0


def test_merge_coalesce(spark, rows):
    old = spark.createDataFrame([("k", 1, 2), ("o", 5, 6)], "id string, a int, b int")
    new = spark.createDataFrame([("k", None, 3), ("n", 7, None)], "id string, a int, b int")
    merged = upsert.merge_coalesce(old, new, ["id"])
    assert rows(merged) == [("k", 1, 3), ("n", 7, None), ("o", 5, 6)]
    assert rows(upsert.merge_coalesce(merged, new, ["id"])) == rows(merged)
    assert rows(upsert.merge_coalesce(old, new, ["id"], keep_old=["b"])) == [("k", 1, 2), ("n", 7, None), ("o", 5, 6)]


def test_flag_reset_keeps_failed_categories(spark, rows):
    df = spark.createDataFrame([("a", True, True), ("b", False, False)], "k string, x boolean, y boolean")
    hits = spark.createDataFrame([("b", "X"), ("b", "Y")], "k string, category string")
    assert rows(upsert.flag_reset_set(df, hits, ["k"], {"X": "x", "Y": "y"}, ["X"])) == [("a", False, True), ("b", True, False)]


def test_diff_of_equal_tables_is_empty(spark, rows):
    df = spark.createDataFrame([(1, [1, 2], "x"), (2, None, None)], "k int, l array<int>, s string")
    assert diff.snapshot_diff(df, df, ["k"]).count() == 0
    turned = df.withColumn("l", F.reverse("l"))
    assert diff.snapshot_diff(df, turned, ["k"]).count() == 0
    changed = df.withColumn("s", F.when(F.col("k") == 2, "new").otherwise(F.col("s")))
    assert rows(diff.snapshot_diff(df, changed, ["k"])) == [(2, "changed", "s", None, "new")]
    assert rows(diff.snapshot_diff(df, changed, ["k"], ignore=["s"])) == []


def test_pages_concatenate_to_the_whole_table(spark):
    df = spark.range(25)
    seen, cursor = [], None
    while True:
        items, following = paging.page_after(df, "id", cursor, 10)
        seen += [r.id for r in items.collect()]
        nxt = following.collect()
        if not nxt:
            break
        cursor = nxt[0].next_cursor
    assert seen == list(range(25))
    assert [r.id for r in paging.page(df, "id", 20, 10).collect()] == list(range(20, 25))


def test_take_zero_has_no_next(spark):
    items, following = paging.page_after(spark.range(5), "id", None, 0)
    assert items.count() == 0 and following.count() == 0
    with pytest.raises(ValueError):
        paging.page(spark.range(5), "id", take=101)


def test_chunks_cover_all_codes(spark):
    df = spark.createDataFrame([("t", i * 3 + 1) for i in range(50)], "term string, code int")
    chunks = sorted(tuple(r)[1:] for r in paging.chunk_bounds(df, ["term"], "code", n=20, last=500, width=16).collect())
    assert chunks == [(1, 1, 58), (2, 59, 118), (3, 119, 500)]


def test_intersection_and_minus(spark, rows):
    df = spark.createDataFrame([(1, [1, 2, 3], [2, 3, 4])], "k int, a array<int>, b array<int>")
    assert df.select(diff.intersect_all("a", "b")).first()[0] == [2, 3]
    assert rows(diff.minus_keys(spark.range(3), spark.range(1, 2), "id")) == [(0,), (2,)]


DOCS = [(1, "Data structures and algorithms", "Trees, heaps and sorting of data."), (2, "Databases", "Query structures and data studies"),
        (3, "Art of the fugue", "Counterpoint studies."), (4, "Intro to CompSci 161", "algorithms data")]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string")
    return search.build_index(docs, "id", {"C": ["title"], "D": ["body"]})


@pytest.mark.parametrize("query,ids", [
    (search.Query(all_of=["data", "structure"]), [1, 2]),
    (search.Query(all_of=["struct"]), [1, 2]),
    (search.Query(all_of=["struct"], prefix_last=False), []),
    (search.Query(any_of=["fugue", "heap"]), [1, 3]),
    (search.Query(all_of=["data"], none_of=["heaps"]), [2, 4]),
    (search.Query(phrases=["art of the fugue"]), [3]),
    (search.Query(phrases=["fugue art"]), []),
    (search.Query(none_of=["data"]), [3]),
    (search.Query(all_of=["the", "of"]), []),
    (search.Query(all_of=["cs161"], aliases={"COMPSCI": "CS"}), [4]),
    (search.Query(all_of=["studies"]), [2, 3]),
])
def test_search_matching(index, query, ids):
    assert sorted(r.id for r in search.match_terms(index, "id", query).collect()) == ids


def test_search_ranks_titles_first_and_counts_all(index):
    page, count = search.search(index, "id", search.Query(all_of=["algorithms"]), take=1)
    assert [r.id for r in page.collect()] == [1] and count.first()[0] == 2


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Many small documents in parts and buckets, and the same index as a plain table."""
    rnd = random.Random(11)
    vocabulary = ["data", "heap", "heaps", "structural", "fugue", "art", "the", "of", "bach", "study", "studies", "deal", "q"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 9))),
                                   " ".join(rnd.choices(vocabulary, [1] * 12 + [.01], k=rnd.randint(0, 40)))) for i in range(700)],
                                 "id long, title string, body string")
    fields = {"C": ["title"], "D": ["body"]}
    path = str(tmp_path_factory.mktemp("index"))
    search.write_index(docs, path, "id", fields, parts=40, buckets=8, spread=2)
    return search.Index(spark, path, "id", buckets=8), search.build_index(docs, "id", fields).cache()


QUERIES = (search.Query(all_of=["data", "struct"]), search.Query(all_of=["d"]), search.Query(phrases=["art of the fugue"]),
           search.Query(any_of=["q", "fugue"], none_of=["bach"]), search.Query(none_of=["study"]), search.Query(all_of=["the"]),
           search.Query(all_of=["heaps", "q"], prefix_last=False), search.Query(all_of=["data"], phrases=["heap data", "study art"]))


@pytest.mark.parametrize("query", QUERIES)
def test_stored_index_answers_the_same(stored, rows, query):
    index, plain = stored
    assert rows(search.match_terms(index, "id", query)) == rows(search.match_terms(plain, "id", query))


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("skip,take", [(0, 5), (3, 20), (0, 2000)])
def test_skipping_parts_leaves_the_page_as_it_is(stored, query, skip, take):
    index, plain = stored
    page, _ = search.search(plain, "id", query, skip, take)
    assert [tuple(r) for r in search.top(index, query, skip, take, first=2).collect()] == [tuple(r) for r in page.collect()]


def test_an_index_is_built_without_lists_by_hash_and_without_sending_its_vocabulary(spark, rows, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "heaps of data heap"), (1, "heap"), (2, None), (None, "data"), (None, "heaps")], "id long, title string")
    plans = []
    words, kept = search.stemmed_words, spark.conf.get("spark.sql.execution.useObjectHashAggregateExec")
    monkeypatch.setattr(search, "stemmed_words", lambda *a: plans.append(words(*a)) or plans[-1])
    search.write_index(docs, str(tmp_path / "i"), "id", {"C": ["title"], "D": [F.lit("data")]}, parts=3, buckets=4, spread=2)
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == kept
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "BroadcastExchange" not in plan
    index = search.Index(spark, str(tmp_path / "i"), "id", buckets=4)
    # Rows with one key, or none, are one document, and words of one stem are one term.
    assert rows(index.postings(index.blocks()).select("id", "field", "term", "tf", F.array_join("positions", ","))) == sorted([
        (1, "C", "heap", 3, "1,1,4"), (1, "C", "data", 1, "3"), (1, "D", "data", 2, "1,1"), (2, "D", "data", 1, "1"),
        (None, "C", "data", 1, "1"), (None, "C", "heap", 1, "1"), (None, "D", "data", 2, "1,1")], key=repr)
    assert rows(index.blocks().where("term = 'data'").select(F.sum("n"), F.max("best"))) == [(3, pytest.approx(0.4))]


def test_bounds_hold_and_leave_parts_out(stored):
    index, plain = stored
    query = search.Query(all_of=["q"], prefix_last=False)
    bounds = {r.part: r.bound for r in search.part_bounds(index, query).collect()}
    of = search.match_terms(plain, "id", query).withColumn("part", F.expr("cast(pmod(xxhash64(id), 40) AS int)")).collect()
    assert {r.part for r in of} == set(bounds)
    assert all(r["rank"] <= bounds[r.part] for r in of)
    ranks = sorted((r["rank"] for r in of), reverse=True)
    assert sum(b >= ranks[2] for b in bounds.values()) < len(bounds)


def test_a_query_reads_its_buckets_once(stored):
    index, _ = stored
    page, count = search.search(index, "id", search.Query(all_of=["fugue"], prefix_last=False), take=3)
    both = page.withColumn("total", count.scalar())
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan, plan[:3000]
    scan = index.blocks(search.Query(all_of=["fugue"], prefix_last=False))
    names = [r.name for r in scan.select(F.input_file_name().alias("name")).distinct().collect()]
    assert names and len({n.rsplit("bucket=", 1)[1].split("/")[0] for n in names}) == 1


def test_sections_without_instructor_count(spark):
    sections = spark.createDataFrame([(1, "a", 5, 1.0), (2, "a", 7, 2.0)], "s int, d string, x int, g double")
    bridge = spark.createDataFrame([(1, "p"), (1, "q")], "s int, who string")
    assert aggs.dist_by(sections, ["d"], ["x"], "g", bridge, ["s"]).first()[1] == 12
    assert aggs.dist_by(sections, ["d"], ["x"], "g", bridge, ["s"], staffed_only=True).first()[1] == 5


def test_equal_records_keep_their_section_each(spark):
    records = spark.createDataFrame([("2024", "Summer", 1), ("2024", "Summer", 1), ("2024", "Fall", 1)], "year string, term string, code int")
    section = spark.createDataFrame([("2024", "Summer1", 1, "x"), ("2024", "Summer2", 1, "w"), ("2024", "Fall", 1, "z")],
                                    "year string, term string, code int, k string")
    got = joins.attach_section_key(records, section, ["year", "term", "code"], "term", "k", {"Summer": ["Summer1", "Summer2"]})
    assert sorted(r.k for r in got.collect()) == ["w", "w", "z"]


def test_views_over_text_keys(spark):
    courses = spark.createDataFrame([("X1", "One"), ("X2", "Two")], "course_key string, title string")
    people = spark.createDataFrame([("ab", "A"), ("cd", "C")], "person_key string, name string")
    taught = spark.createDataFrame([("X1", "ab", "2024"), ("X1", "cd", "2024"), ("X1", "cd", "2025")],
                                   "course_key string, person_key string, term string")
    got = {r.course_key: r for r in views.course_view(courses, people, taught, F.lit(True)).collect()}
    assert [p.person_key for p in got["X1"].instructors] == ["ab", "cd"] and got["X1"].terms == ["2024", "2025"]
    assert got["X2"].instructors == [] and got["X2"].terms == []
    mine = {r.person_key: r for r in views.person_view(courses, people, taught, F.lit(True)).collect()}
    assert [(c.course_key, c.terms) for c in mine["cd"].courses] == [("X1", ["2024", "2025"])]


def test_group_intersection_keeps_people_as_rows(spark, rows):
    sections = spark.createDataFrame([("a", "c", "A"), ("b", "c", "A2"), ("b", "c", "A2"), ("e", "c", "B"), ("f", "d", "1"), (None, "d", "2")],
                                     "s string, c string, n string")
    bridge = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "z"), ("f", "x"), ("f", None)], "s string, who string")
    shared = aggs.group_intersection(sections, bridge, "s", "c", "n", "who")
    assert rows(shared, "s", "who") == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", "y"), ("b", "y"), ("f", "x"), ("f", None)]
    assert "collect_set" not in shared._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_made_with_two_moves(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running runs run", "the runs of dogs"), (1, "", "dog"), (2, None, "Dogs"), (None, "cat", "cat cats")],
                                 "id int, title string, body string")
    fields = {"C": ["title"], "D": ["body"]}
    with search._sorted_lists(spark):
        blocks = search._blocks(docs, "id", fields, 3, 4)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan  # blocks move once more to their bucket
        assert all(r.n == len(r.postings) for r in blocks.collect())
    search.write_index(docs, f"{tmp_path}/index", "id", fields)
    index = search.Index(spark, f"{tmp_path}/index", "id")
    got = index.postings(index.blocks()).select("id", "field", "term", "tf", "positions").collect()
    want = search.build_index(docs, "id", fields).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert (1, "C", "run", 3, [1, 2, 3]) in map(tuple, got) and (1, "D", "dog", 2, [1, 4]) in map(tuple, got)

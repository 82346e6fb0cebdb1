import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadlake.sources import feeds, sinks, tabular, markup
from quadlake.streaming import snapshots

EVENT = "event_id long, ts timestamp_ntz, user_id long, value double"


def test_csv_import(spark, tmp_path, rows):
    (tmp_path / "g.csv").write_text("CalYr,AcadTerm,CourseCode,GradeACount\n2024,Fall,1,5\n2024,Fall,1,6\n2024,Fall,,7\n,,,\n")
    raw = tabular.read_csv(spark, str(tmp_path / "g.csv"), ["CalYr", "AcadTerm", "CourseCode", "GradeACount"])
    raw = raw.withColumn("line", F.monotonically_increasing_id())
    kept, rejected = tabular.import_tabular(raw, ["CalYr", "AcadTerm", "CourseCode", "GradeACount"], ["CalYr", "AcadTerm", "CourseCode"], ["line"])
    assert rows(kept, "CourseCode", "GradeACount") == [("1", "6")] and rows(rejected, "GradeACount") == [("7",)]
    with pytest.raises(ValueError):
        tabular.import_tabular(raw, ["Missing"], ["CalYr"], ["line"])


def test_json_feed(spark, rows):
    raw = spark.createDataFrame([(1, '{"message":"OK","data":{"id":1}}'), (2, '{"error":"x"}'), (3, "not json"), (4, None)], "k int, p string")
    good, bad = feeds.parse_json_feed(raw, "p", "message string, data struct<id: int>", required=("data",))
    assert rows(good, "k", "data.id") == [(1, 1)] and rows(bad, "k") == [(2,), (3,), (4,)]


def test_xml_single_and_repeated_nodes(spark):
    full = ('<section><course_code>100</course_code><sec_type>Lec</sec_type><sec_num>A</sec_num><sec_units>4</sec_units>'
            '<sec_instructors><instructor>A, B.</instructor><instructor/><instructor>C &amp; D</instructor></sec_instructors><sec_modality>In-person</sec_modality>'
            '<sec_meetings><sec_meet><sec_days>MWF</sec_days><sec_time>9-9:50</sec_time><sec_bldg>HALL</sec_bldg><sec_room>1</sec_room></sec_meet>'
            '<sec_meet><sec_days>Tu</sec_days><sec_bldg>LAB</sec_bldg></sec_meet></sec_meetings>'
            '<sec_final><sec_final_date>Mar 3</sec_final_date><sec_final_day>Mon</sec_final_day><sec_final_time>8-10am</sec_final_time></sec_final>'
            '<sec_enrollment><sec_max_enroll>9</sec_max_enroll><sec_enrolled>8</sec_enrolled><sec_waitlist>100</sec_waitlist><sec_wait_cap>3</sec_wait_cap>'
            '<sec_enroll_requests>7</sec_enroll_requests><sec_new_only_reserved>100</sec_new_only_reserved></sec_enrollment>'
            '<sec_restrictions>A and B</sec_restrictions><sec_status>OPEN</sec_status><sec_comment>Note</sec_comment></section>')
    tba = "<section><course_code>200</course_code><sec_final><sec_final_date>TBA</sec_final_date></sec_final></section>"
    doc = ('<?xml version="1.0"?><websoc_results><course_list><school school_name="S &amp; T"><school_comment>hi</school_comment>'
           '<department dept_code="D" dept_name="Dept" dept_case="x"><course_code_range_comment range="1-2">codes</course_code_range_comment>'
           f'<course course_number="1" course_title="One">{full}</course><course course_number="2"><course_comment>c</course_comment>{tba}{tba.replace("200", "201")}</course>'
           "</department></school></course_list></websoc_results>")
    empty = "<websoc_results><course_list/></websoc_results>"
    tables = feeds.parse_xml_listing(spark.createDataFrame(
        [(1, doc), (2, doc[:-20]), (3, "no listing"), (4, None), (5, empty)], "k int, d string"), "d", ["k"])
    assert {r.k: r.d for r in tables.pop("rejected").collect()} == {2: doc[:-20], 3: "no listing", 4: None}
    assert {n: df.count() for n, df in tables.items()} == {"school": 1, "department": 1, "course": 2, "section": 3}
    assert tuple(tables["school"].first()) == (1, "S & T", "hi")
    assert tuple(tables["department"].first())[1:] == ("S & T", "D", "Dept", "", ["codes"], [])
    r = {r.section_code: r for r in tables["section"].collect()}
    a = r["100"]
    assert (a.department, a.course_number, a.title, a.section_type, a.section_num, a.units, a.modality, a.restrictions, a.status, a.comment) == (
        "D", "1", "One", "Lec", "A", "4", "In-person", "A and B", "OPEN", "Note")
    assert a.instructors == ["A, B.", "C & D"] and [tuple(m) for m in a.meetings] == [("MWF", "9-9:50", "HALL 1"), ("Tu", "", "LAB")]
    assert (a.final_exam, a.max_capacity, a.total_enrolled, a.section_enrolled, a.waitlist, a.waitlist_cap, a.requested, a.reserved) == (
        "Mon Mar 3 8-10am", "9", "8", "", "", "3", "7", "")
    assert (r["200"].final_exam, r["200"].meetings, r["200"].instructors, r["200"].title) == ("TBA", [], [], "")


def test_listings_are_parsed_once(spark):
    raw = spark.createDataFrame([(1, "<websoc_results/>")], "k int, d string")
    for name, table in feeds.parse_xml_listing(raw, "d", ["k"]).items():
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml") == 1, (name, plan)


def test_web_links(spark):
    html = ('<table><tr><td>Code</td></tr><tr><td> 34000 </td><td><a href="/x"> Book</a> <a href="http://w/1?a=1&amp;b=2">Web</a></td></tr>'
            "<tr><td>34001<td>none</table><a href='/out'>Web</a>")
    pages = spark.createDataFrame([(1, html)], "k int, html string")
    got = feeds.web_links(markup.elements(pages, "k", "html"), "k").collect()
    assert [(r.section_code, r.web_url) for r in got] == [("34000", "http://w/1?a=1&b=2")]


def test_publish_moves_the_table(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish(spark.range(3).toDF("x"), root, "numbers", "1")
    assert spark.table("numbers").count() == 3
    # The job reads the table it replaces.
    sinks.refresh_view(lambda: spark.table("numbers").where("x > 0"), root, "numbers", "2")
    assert spark.table("numbers").count() == 2
    other = spark.newSession()
    assert other.table("numbers").count() == 2
    # A job that stops half-way leaves the table where it was, for every session.
    broken = spark.range(9).select(F.raise_error(F.lit("stopped")).cast("long").alias("x"))
    with pytest.raises(Exception, match="stopped"):
        sinks.publish(broken, root, "numbers", "3")
    assert other.table("numbers").count() == 2 and spark.table("numbers").count() == 2
    sinks.publish(spark.range(5).toDF("x"), root, "numbers", "3")
    assert spark.newSession().table("numbers").count() == 5
    other.catalog.refreshTable("numbers")
    assert other.table("numbers").count() == 5
    assert sinks.child_folders(spark, f"{root}/numbers") == ["v=2", "v=3"]
    sinks.publish(spark.range(5).selectExpr("id AS x", "'a' AS y"), root, "numbers", "4")
    assert spark.newSession().table("numbers").columns == ["x", "y"]
    paths = sinks.publish_all(spark, {"a": spark.range(1), "b": spark.range(2)}, root, "1")
    assert list(paths) == ["a", "b"] and spark.table("b").count() == 2


def test_replace_partitions_and_all(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    sinks.replace_all(base, path, ["p"])
    sinks.replace_partitions(spark.createDataFrame([(3, "b")], "x int, p string"), path, ["p"])
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3]
    sinks.replace_all(spark.createDataFrame([(9, "z")], "x int, p string"), path, ["p"])
    assert [r.x for r in spark.read.parquet(path).collect()] == [9]


@pytest.fixture
def dropped(spark, tmp_path):
    """Three landed files: repeats, a late row for a known day, a newer row."""
    folder = tmp_path / "landing"
    batches = [
        [(1, "2024-01-01 08:00:00", 7, 1.0), (2, "2024-01-01 09:00:00", 7, 2.0), (3, "2024-01-01 09:00:00", 8, 3.0)],
        [(4, "2024-01-01 07:00:00", 7, 4.0), (2, "2024-01-01 09:00:00", 7, 2.0), (5, "2024-01-02 09:00:00", 8, 5.0)],
        [(6, "2024-01-02 10:00:00", 7, 6.0), (5, "2024-01-02 09:00:00", 8, 5.0)]]
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "event_id long, t string, user_id long, value double")
        (df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "value")
         .coalesce(1).write.parquet(str(folder / f"drop={i}")))
    return str(folder)


def source(spark, folder):
    return snapshots.landed(spark, folder + "/drop=*", EVENT, files_per_batch=1)


def test_latest_and_history_stream(spark, dropped, rows):
    root = snapshots.run_folder(spark, "t")
    query = snapshots.start_latest(source(spark, dropped), root, "user_id", "ts", "event_id")
    query.awaitTermination()
    current = snapshots.current_table(spark, root, "current", snapshots.last_batch(query))
    assert rows(current, "user_id", "event_id") == [(7, 6), (8, 5)]
    history = snapshots.history_table(spark, root, "history")
    assert rows(history, "event_id") == [(1,), (2,), (3,), (4,), (5,), (6,)]


def test_daily_first_stream(spark, dropped, rows):
    root = snapshots.run_folder(spark, "t")
    snapshots.start_daily_first(source(spark, dropped), root, "user_id", "ts", "event_id").awaitTermination()
    # The first to arrive stays, even when an earlier row comes later.
    assert rows(snapshots.history_table(spark, root, "daily"), "user_id", "event_id") == [(7, 1), (7, 6), (8, 3), (8, 5)]


def test_a_repeated_batch_changes_nothing(spark, dropped, rows):
    root = snapshots.run_folder(spark, "t")
    df = spark.read.schema(EVENT).parquet(dropped + "/drop=0")
    later = spark.read.schema(EVENT).parquet(dropped + "/drop=1")
    for batch, frame in ((0, df), (0, df), (1, later), (1, later)):
        snapshots._append_new(frame, root, "history", batch, ["user_id", "ts"], "ts")
    assert rows(snapshots.history_table(spark, root, "history"), "event_id") == [(1,), (2,), (3,), (4,), (5,)]


def test_slot_stream(spark, tmp_path, rows):
    schema = "room string, starts timestamp_ntz, ends timestamp_ntz, available boolean"

    def slots(*values):
        return " UNION ALL ".join(f"SELECT 'r' room, TIMESTAMP_NTZ '{s}' starts, TIMESTAMP_NTZ '{e}' ends, {a} available" for s, e, a in values)

    drops = [[("2024-01-02 09:00:00", "2024-01-02 10:00:00", "true"), ("2024-01-05 09:00:00", "2024-01-05 10:00:00", "true"),
              ("2023-01-01 09:00:00", "2023-01-01 10:00:00", "true"), ("2024-01-03 08:00:00", "2024-01-03 09:00:00", "true")],
             [("2024-01-05 09:00:00", "2024-01-05 10:00:00", "false"), ("2024-01-01 09:00:00", "2024-01-01 10:00:00", "true")],
             [("2024-01-06 09:00:00", "2024-01-06 10:00:00", "CAST(NULL AS boolean)")]]
    for i, values in enumerate(drops):
        spark.sql(slots(*values)).coalesce(1).write.parquet(str(tmp_path / f"drop={i}"))
    root = snapshots.run_folder(spark, "t")
    times = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 12)]
    query = snapshots.start_slots(snapshots.landed(spark, str(tmp_path) + "/drop=*", schema, 1), root, iter(times).__next__)
    query.awaitTermination()
    # Past days are gone as folders; the ended slot of today only for readers.
    assert sinks.child_folders(spark, f"{root}/slots") == ["end_day=2024-01-03", "end_day=2024-01-05", "end_day=2024-01-06"]
    left = snapshots.slots_table(spark, root, snapshots.last_batch(query), times[-1])
    assert rows(left.withColumn("day", F.dayofmonth("ends")), "day", "available") == [(5, False), (6, None)]


def test_a_batch_reads_and_writes_what_it_touches(spark, tmp_path, rows):
    """One row for each of eight keys, then one key at a time: the other buckets keep their first version."""
    drops = [[(k, k, f"2024-01-0{k % 3 + 1} 00:00:00") for k in range(8)], *[[(100 + i, 3, f"2024-02-0{i} 00:00:00")] for i in range(1, 7)]]
    for i, values in enumerate(drops):
        spark.sql(" UNION ALL ".join(f"SELECT {e}L event_id, TIMESTAMP_NTZ '{t}' ts, {k}L user_id" for e, k, t in values)).coalesce(1).write.parquet(
            str(tmp_path / f"drop={i}"))
    root = snapshots.run_folder(spark, "t")
    source = snapshots.landed(spark, str(tmp_path) + "/drop=*", "event_id long, ts timestamp_ntz, user_id long", 1)
    query = snapshots.start_latest(source, root, "user_id", "ts", "event_id", buckets=4)
    query.awaitTermination()
    last = snapshots.last_batch(query)
    assert last == 6
    versions = {b: sinks.child_folders(spark, f"{root}/current/{b}") for b in sinks.child_folders(spark, f"{root}/current") if "=" in b}
    hot = [v for v in versions.values() if len(v) > 1]
    # Of the hot bucket the version of batch 3 is still the newest before the last three; the older ones are gone.
    assert hot == [["v=3", "v=4", "v=5", "v=6"]] and all(v == ["v=0"] for v in versions.values() if len(v) == 1)
    assert rows(snapshots.current_table(spark, root, "current", last), "user_id", "event_id") == [
        (k, 106 if k == 3 else k) for k in range(8)]
    assert (3, 104) in rows(snapshots.current_table(spark, root, "current", 4), "user_id", "event_id")
    folders = snapshots.latest_folders(spark, f"{root}/current", ["bucket=0"], last)
    read = snapshots.read_folders(spark, f"{root}/current", folders, source.schema, "v", "bucket")
    assert {f.split("bucket=")[1][0] for f in read.inputFiles()} == {"0"}


def test_shared_folder_comes_from_the_session(spark):
    assert snapshots.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    left = spark.range(100).selectExpr("id AS section_key", "id % 7 AS x")
    right = spark.range(100).selectExpr("id AS section_key", "id % 5 AS y")
    sinks.save_bucketed(left, "bucket_left", ["section_key"], 4, str(tmp_path / "l"))
    sinks.save_bucketed(right, "bucket_right", ["section_key"], 4, str(tmp_path / "r"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucket_left").join(spark.table("bucket_right"), "section_key")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucket_left")
        spark.sql("DROP TABLE bucket_right")

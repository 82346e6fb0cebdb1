import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadlake.functions import fixed
from quadlake.questions import campus, catalogue, offerings


def flags(df, names, on):
    return df.withColumns({n: F.array_contains(F.col(on), n) for n in names})


@pytest.fixture(scope="module")
def offered(spark):
    course = spark.createDataFrame(
        [(1, "2024", "Fall", "COMPSCI", "161", 161, "COMPSCI161", "Algorithms", ["ge_5b"]),
         (2, "2024", "Fall", "COMPSCI", "H45", 45, "COMPSCIH45", "Honors", []),
         (3, "2024", "Summer1", "MATH", "2A", 2, "MATH2A", "Calculus", ["ge_5b", "ge_2"])],
        "course_key int, year string, quarter string, department string, course_number string, course_numeric int, course_id string, title string, on array<string>")
    section = spark.createDataFrame(
        [(10, 1, 34000, "Lec", "4", "OPEN", 5, 5, 9, False, "http://a", ["r_a"]), (11, 1, 34001, "Dis", "0", "FULL", 9, 12, 9, False, "", []),
         (12, 2, 35000, "Lec", "1-4", "Waitl", 9, 9, 9, True, "http://b", []), (13, 3, 44000, "Lec", "4", None, 1, 1, 9, False, "http://c", [])],
        "section_key int, course_key int, section_code int, section_type string, units string, status string, enrolled int, total_enrolled int, capacity int, cancelled boolean, web_url string, on array<string>")
    meeting = spark.createDataFrame(
        [(100, 10, 0, 600, 650, ["meets_m", "meets_w"]), (101, 10, 1, 900, 950, ["meets_f"]), (102, 11, 0, 600, 650, ["meets_tu"]), (103, 13, 0, 600, 650, ["meets_m"])],
        "meeting_key int, section_key int, meeting_index int, start_minute int, end_minute int, on array<string>")
    place = spark.createDataFrame([(100, "HALL", "1"), (101, "LAB", "2"), (103, "HALL", "9")], "meeting_key int, building string, room string")
    staff = spark.createDataFrame([(10, "KNUTH, D."), (10, "TARJAN, R."), (11, "KNUTH, D."), (13, "GAUSS, C.")], "section_key int, instructor string")
    grade = spark.createDataFrame([(10, 5, 1, 0, 0, 0, 0, 0, 1, 3.5), (11, 0, 0, 0, 0, 0, 9, 1, 0, None), (13, 2, 2, 2, 0, 0, 0, 0, 0, 2.5)],
                                  "section_key int, a int, b int, c int, d int, f int, p int, np int, w int, average double")
    snapshot = spark.createDataFrame(
        [(10, dt.date(2024, 9, 2), 4, 9, None, None, 1, 0, "OPEN"), (10, dt.date(2024, 9, 1), 3, 9, 0, 5, 1, 0, "OPEN"), (12, dt.date(2024, 9, 1), 3, 9, 0, 5, 1, 0, "OPEN")],
        "section_key int, day date, total_enrolled int, capacity int, waitlist int, waitlist_cap int, requested int, reserved int, status string")
    material = spark.createDataFrame([(10, 1, "Cormen", "Intro to Algorithms"), (13, 2, "Stewart", "Calculus")], "section_key int, material_key int, author string, title string")
    tutoring = flags(spark.createDataFrame([(1, "TUTOR, T.", "HALL", 600, 650, ["meets_m"]), (1, "TUTOR, A.", "ON LINE", 500, 550, ["meets_f"])],
                     "course_key int, instructor string, building string, start_minute int, end_minute int, on array<string>"), offerings.DAYS.values(), "on").drop("on")
    department = spark.createDataFrame([("2022", "Fall", "COMPSCI", "Old name"), ("2024", "Fall", "COMPSCI", "Computer Science"), ("2024", "Winter", "MATH", "Mathematics")],
                                       "year string, quarter string, department string, department_name string")
    return {
        "course": flags(course, offerings.CATEGORIES.values(), "on").drop("on"),
        "section": flags(section, offerings.RESTRICTIONS.values(), "on").drop("on"),
        "meeting": flags(meeting, offerings.DAYS.values(), "on").drop("on"), "place": place, "staff": staff, "grade": grade,
        "snapshot": snapshot, "material": material, "tutoring": tutoring, "department": department}


@pytest.mark.parametrize("where,keys", [
    ({}, [10, 11, 12]), ({"department": "COMPSCI", "level": "UpperDiv"}, [10, 11]), ({"section_codes": "34001-35000"}, [11, 12]),
    ({"course_numbers": "H45"}, [12]), ({"instructor": "tarjan"}, [10]), ({"days": "W"}, [10]), ({"building": "hall"}, [10]),
    # Meeting and place have to be the same meeting.
    ({"days": "F", "building": "Hall"}, []), ({"days": "F", "building": "Lab"}, [10]), ({"fill": "SkipFull"}, [10, 12]),
    ({"fill": "Overenrolled"}, [11]), ({"cancelled": "Exclude"}, [10, 11]), ({"units": "VAR"}, [12]), ({"category": "GE-5B"}, [10, 11]),
    ({"exclude_restrictions": ["A"]}, [11, 12]), ({"after": "2:00pm"}, [10]), ({"section_type": "Dis", "related": True}, [10, 11]),
])
def test_sections(offered, where, keys):
    assert sorted(r.section_key for r in offerings.sections(offered, "2024", "Fall", **where).collect()) == keys


def test_terms_and_departments(offered, rows):
    assert [r.short_name for r in offerings.terms(offered).collect()] == ["2024 Fall", "2024 Summer1"]
    assert rows(offerings.departments(offered)) == [("COMPSCI", "Computer Science"), ("MATH", "Mathematics")]
    assert rows(offerings.departments(offered, until=("2023", None))) == [("COMPSCI", "Old name")]


def test_syllabi(offered, rows):
    assert rows(offerings.syllabi(offered, "COMPSCI161"), "web_url", "instructors") == [("http://a", ["KNUTH, D.", "TARJAN, R."])]
    assert rows(offerings.syllabi(offered, "COMPSCI161", instructor="TARJAN, R."), "instructors") == [(["TARJAN, R."],)]
    assert rows(offerings.syllabi(offered, "COMPSCIH45"), "web_url", "instructors") == [("http://b", [])]


def test_grades(offered, rows):
    total, members = offerings.grade_totals(offered, department="COMPSCI")
    assert tuple(total.first()) == (5, 1, 0, 0, 0, 9, 1, 1, 3.5) and members.count() == 2
    assert rows(offerings.grades_by_course(offered), "course_number", "a", "p") == [("161", 5, 9), ("2A", 2, 0)]
    assert rows(offerings.grades_by_offering(offered, instructor="KNUTH, D."), "instructor", "a", "p") == [("KNUTH, D.", 5, 9)]
    assert rows(offerings.grades(offered, exclude_pass_only=True), "section_code", "instructors") == [
        ("34000", ["KNUTH, D.", "TARJAN, R."]), ("44000", ["GAUSS, C."])]
    assert ("instructor", "GAUSS, C.") in rows(offerings.grade_options(offered, quarter="Summer1"))


def test_history_materials_tutoring(offered, rows):
    # Section 12 has snapshots but no place.
    history = offerings.enrollment_history(offered, year="2024")
    assert rows(history, "section_key", "dates", "total_enrolled", "waitlist") == [(10, ["2024-09-01", "2024-09-02"], ["3", "4"], ["0", ""])]
    assert rows(offerings.materials(offered, quarter="Summer"), "title", "quarter") == [("Calculus", "Summer")]
    assert rows(offerings.materials(offered, author="corm", instructor="tarj"), "section_code") == [(34000,)]
    nested = offerings.tutoring(offered, department="COMPSCI").collect()
    assert [[s.instructor for s in r.sections] for r in nested] == [["TUTOR, A.", "TUTOR, T."]]
    assert offerings.tutoring(offered, days="W").count() == 0


@pytest.fixture(scope="module")
def listed(spark, offered):
    course_view = offered["course"].where("year = '2024'").withColumns(
        {"description": F.lit("About sorting"), "min_units": F.lit(4.0), "max_units": F.lit(4.0)})
    major = spark.createDataFrame([("BS-1", "CS", "BS")], "id string, name string, degree_id string")
    link = spark.createDataFrame([("BS-1", None, "20222023", 1), ("BS-1", "BS-1A", "20242025", 2), ("BS-1", None, "20242025", 3)],
                                 "major_id string, specialization_id string, catalog_year string, requirement_id long")
    return {
        "course_view": course_view, "department": offered["department"],
        "person_view": spark.createDataFrame([("dk", "Don Knuth", "Professor", "Computer Science"), ("cg", "Carl Gauss", "Professor", "Mathematics")],
                                             "person_id string, name string, title string, department string"),
        "major": major, "degree": spark.createDataFrame([("BS", "Bachelor", "Undergraduate")], "id string, name string, division string"),
        "major_year": spark.createDataFrame([("BS-1", "20222023", True), ("BS-1", "20242025", True)], "major_id string, catalog_year string, specialization_required boolean"),
        "major_requirement_link": link, "requirement": spark.createDataFrame([(1, "old"), (2, "spec"), (3, "new")], "id long, requirements string"),
        "minor": spark.createDataFrame([("M1", "Minor")], "id string, name string"),
        "minor_requirement": spark.createDataFrame([("M1", "20222023", "a"), ("M1", "20242025", "b")], "minor_id string, catalog_year string, requirements string"),
        "specialization": spark.createDataFrame([("BS-1A", "BS-1", "Systems")], "id string, major_id string, name string"),
        "specialization_requirement": spark.createDataFrame([("BS-1A", "20242025", "s")], "specialization_id string, catalog_year string, requirements string"),
        "school_requirement": spark.createDataFrame([("20242025", "GE", "g")], "catalog_year string, kind string, requirements string"),
        "sample_program": spark.createDataFrame([("cs", "CS"), ("x", "X")], "program_id string, name string"),
        "variation": spark.createDataFrame([("cs", 2, "b", "y2"), ("cs", 1, "a", "y1")], "program_id string, variation_id long, label string, years string"),
        "exam": spark.createDataFrame([("CALC", "Calculus"), ("NONE", "Nothing")], "exam string, catalogue_name string"),
        "reward": spark.createDataFrame([("r1", "CALC", 4, 1, 0)], "reward_id string, exam string, units int, ge_5b int, ge_2 int"),
        "score": spark.createDataFrame([("CALC", 5, "r1"), ("CALC", 4, "r1")], "exam string, score int, reward_id string")}


def test_courses_and_people(listed, rows):
    assert rows(catalogue.courses(listed, level="UpperDiv"), "course_id") == [("COMPSCI161",)]
    assert rows(catalogue.courses(listed, title="alg", min_units=0, category="GE-5B"), "course_id") == [("COMPSCI161",)]
    assert rows(catalogue.courses_by_id(listed, ["MATH2A"]), "title") == [("Calculus",)]
    items, following = catalogue.courses_after(listed, take=2)
    assert items.count() == 2 and following.first().next_cursor == "MATH2A"
    assert rows(catalogue.people(listed, name="knu"), "person_id") == [("dk",)]
    assert catalogue.people_after(listed, take=1)[1].first().next_cursor == "dk"
    assert rows(catalogue.people_by_id(listed, "cg"), "name") == [("Carl Gauss",)]
    assert rows(catalogue.matching_departments(listed, ["COMPSCI"]), "person_id") == [("dk",)]


def test_programs(listed, rows):
    assert rows(catalogue.majors(listed), "catalog_year", "specializations") == [("20242025", ["BS-1A"])]
    assert rows(catalogue.majors(listed, catalog_year="20212022"), "catalog_year", "specializations") == [("20222023", [])]
    assert rows(catalogue.major_requirements(listed, "BS-1"), "requirements") == [("new",)]
    assert rows(catalogue.major_requirements(listed, "BS-1", "BS-1A", "20202021"), "requirements") == [("spec",)]
    assert rows(catalogue.specializations(listed, "BS-1", "20222023"), "id") == []
    assert rows(catalogue.specializations(listed), "id") == [("BS-1A",)]
    assert rows(catalogue.minors(listed)) == [("M1", "Minor")]
    assert rows(catalogue.minor_requirements(listed, "M1", "20232024"), "requirements") == [("b",)]
    assert rows(catalogue.specialization_requirements(listed, "BS-1A"), "requirements") == [("s",)]
    assert rows(catalogue.school_requirements(listed, "GE", "20002001"), "requirements") == [("g",)]
    programs = {r.program_id: [v.label for v in r.variations] for r in catalogue.sample_programs(listed).collect()}
    assert programs == {"cs": ["a", "b"], "x": []}
    credit = catalogue.exam_credit(listed).collect()
    assert [(r.exam, r.acceptable_scores, r.categories_granted) for r in credit] == [("CALC", [4, 5], {"GE-5B": 1})]


@pytest.fixture(scope="module")
def places(spark):
    def ts(text):
        return dt.datetime.fromisoformat(text)

    hours = {f"{k}_{d.lower()}": F.lit(None).cast("string") for d in fixed.HOURS_DAYS for k in ("open", "close")}
    return {
        "event": spark.createDataFrame([("a", "Past", ts("2024-01-01"), ts("2024-01-02"), ts("2024-01-01")), ("a", "Open", None, None, ts("2024-02-20"))],
                                       "restaurant string, title string, starts timestamp_ntz, ends timestamp_ntz, updated_at timestamp_ntz"),
        "dish": spark.createDataFrame([("1", "s", "Soup"), ("2", "s", "Rice")], "sku string, station_id string, name string"),
        "nutrition": spark.createDataFrame([("1", 90.0), ("2", 80.0)], "sku string, calories double"),
        "diet": spark.createDataFrame([("1", True)], "sku string, is_vegan boolean"),
        "served": spark.createDataFrame([("a", dt.date(2024, 1, 1), 7, "s", "2"), ("a", dt.date(2024, 1, 1), 7, "s", "1"), ("a", dt.date(2024, 1, 3), 7, "s", "1")],
                                        "restaurant string, date date, period_id int, station_id string, sku string"),
        "station": spark.createDataFrame([("a", "s", "Soups"), ("a", "g", "Grill")], "restaurant string, station_id string, name string"),
        "schedule": spark.createDataFrame([(1, "a", "Break", "special", dt.date(2024, 3, 1), dt.date(2024, 3, 9)), (2, "a", "Usual", "standard", None, None), (3, "a", "Gone", "special", dt.date(2023, 3, 1), dt.date(2023, 3, 9))],
                                          "schedule_id int, restaurant string, name string, kind string, starts date, ends date"),
        "period": spark.createDataFrame([(2, 8, 2), (2, 7, 1)], "schedule_id int, period_id int, position int").withColumns({**hours, "open_mo": F.lit("07:15")}),
        "room": spark.createDataFrame([("r1", "Main", 4, True, None), ("r2", "Side", 8, False, "http://own")], "room string, location string, capacity int, tech_enhanced boolean, url string"),
        "slot": spark.createDataFrame([("r1", ts("2024-07-01T10:00"), ts("2024-07-01T11:00"), True), ("r1", ts("2024-07-01T09:00"), ts("2024-07-01T10:00"), False)],
                                      "room string, starts timestamp_ntz, ends timestamp_ntz, available boolean"),
        "occupancy": spark.createDataFrame([("1", "Main", "Floor 1", 5), ("2", "Side", "Floor 2", 6)], "location_id string, place string, location string, count int"),
        "term": spark.sql("SELECT '2025' year, 'Fall' quarter, DATE '2025-09-25' instruction_start, DATE '2025-12-05' instruction_end, DATE '2025-12-06' finals_start, DATE '2025-12-12' finals_end, DATE '2025-04-20' soc_available")}


def test_dining(places, rows):
    assert rows(campus.dining_events(places, "2024-03-01 00:00:00"), "title") == [("Open",)]
    assert rows(campus.dining_events(places, "2024-03-01 00:00:00", after="2023-12-31", before="2024-01-01"), "title") == [("Past",)]
    whole, missing = campus.dishes(places, ["1", "2"])
    assert rows(whole, "sku", "calories", "is_vegan") == [("1", 90.0, True)] and rows(missing) == [("2", ["diet"])]
    assert tuple(campus.dining_dates(places).first()) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    assert [[s.name for s in r.stations] for r in campus.restaurants(places).collect()] == [["Grill", "Soups"]]
    assert rows(campus.restaurant_day(places, "a", "2024-01-01"), "period_id", "stations") == [(7, {"s": ["1", "2"]})]
    listed = campus.schedules(places, "2024-02-01").collect()
    assert [r.name for r in listed] == ["Usual", "Break"]
    assert [(p.period_id, p.hours.mo.open) for p in listed[0].periods] == [(7, "07:15"), (8, "07:15")] and listed[1].periods == []
    assert campus.schedules(places, "2024-02-01", include_past=True).count() == 3


def test_rooms_and_calendar(spark, places, rows):
    base = dict(tz="America/Los_Angeles", bases={"Main": "http://main/"}, default_base="http://lib/")
    got = {r.room: r for r in campus.study_rooms(places, **base).collect()}
    assert [s.start for s in got["r1"].slots] == ["2024-07-01T16:00:00+00:00", "2024-07-01T17:00:00+00:00"]
    assert got["r1"].slots[0].url == "http://main/r1?date=2024-07-01T16:00:00Z#submit_times"
    assert got["r1"].url == "http://main/r1" and got["r2"].url == "http://own" and got["r2"].slots == []
    late = campus.study_rooms(places, **base, dates=["2024-07-01"], times=[("10:30", "12:00")]).collect()
    assert [(r.room, len(r.slots)) for r in late] == [("r1", 1)]
    assert rows(campus.study_rooms(places, **base, capacity_min=5), "room") == [("r2",)]
    assert rows(campus.occupancy(places, place="Side"), "location") == [("Floor 2",)]
    assert rows(campus.calendar(places, "2025", "Fall"), "instruction_start") == [("2025-09-25",)]
    day = spark.sql("SELECT DATE '2025-10-06' d")
    assert campus.week(places, day, "d").first().display == "Week 2 • Fall Quarter 2025"


def test_stored_tables_answer_the_same(spark, offered, tmp_path, rows):
    from quadlake.sources.scan import question_tables

    names = ["course", "section", "meeting", "place", "staff"]
    for name in names:
        offered[name].write.parquet(str(tmp_path / name))
    stored = question_tables(spark, str(tmp_path), *names)
    where = dict(building="HALL", days="M", instructor="KNUTH")
    assert rows(offerings.sections(stored, "2024", "Fall", **where), "section_code") == [(34000,)]


def test_every_declared_table_is_valid(spark):
    from quadlake.sources import schemas

    for name, ddl in schemas.QUESTIONS.items():
        assert spark.createDataFrame([], ddl).columns, name

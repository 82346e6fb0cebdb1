import pytest
from pyspark.sql import functions as F

from quadlake.functions import parsing
from quadlake.operators import temporal
from quadlake.sources import markup, sinks
from quadlake.plans import calendar, catalogue, dining, grids, listings, occupancy, people, programs, rooms, rules


@pytest.mark.parametrize("text,span", [
    ("11:00-11:50", (660, 710)), ("12:00-12:50p", (720, 770)), ("11:00-2:50p", (660, 890)),
    ("11:00-1:50", (1380, 1550)), (" 9:00 - 9:50pm", (1260, 1310)), ("TBA", (None, None)),
])
def test_minutes_span(spark, text, span):
    got = spark.range(1).select(parsing.minutes_span(F.lit(text)).alias("x")).select("x.*").first()
    assert tuple(got) == span


@pytest.mark.parametrize("text,days", [("MWF", "M W F"), ("TuTh", "Tu Th"), ("Sa", "Sa"), ("SuM", "M Su"), ("", "")])
def test_day_flags(spark, text, days):
    flags = parsing.day_flags(F.lit(text))
    got = spark.range(1).select(*[c.alias(d) for d, c in flags.items()]).first().asDict()
    assert " ".join(d for d, on in got.items() if on) == days


@pytest.mark.parametrize("text,minutes", [("PT1H30M", 90), ("PT30M", 30), ("PT2H", 120), ("PT0S", 0)])
def test_durations(spark, text, minutes):
    assert spark.range(1).select(parsing.duration_minutes(F.lit(text))).first()[0] == minutes


def test_text_helpers(spark):
    df = spark.createDataFrame([("a  ﬁx&amp;lt; ", "O&#39;NEIL van DYKE", "Corequisites: A 1. ")], "a string, b string, c string")
    got = df.select(parsing.norm("a"), parsing.title_case(parsing.decode_entities("b")),
                    parsing.after_label("c", "Corequisite"), parsing.decode_entities("a")).first()
    assert tuple(got) == ("a fix&amp;lt;", "O'neil Van Dyke", "A 1", "a  ﬁx&lt; ")


@pytest.mark.parametrize("text,result", [
    ("May be taken for credit 2 times.", (2, "times", True)), ("May be taken for credit for 12 units.", (12, "credit_hours", True)),
    ("Unlimited as topics vary", (None, None, True)), ("", (0, "times", True)), ("Who knows", (None, None, False)),
])
def test_repeat_rule(spark, text, result):
    assert tuple(spark.range(1).select(*catalogue.repeat_rule(F.lit(text))).first()) == result


@pytest.mark.parametrize("text,low,high", [("1-4 Units.", 1.0, 4.0), ("4 Units.", 4.0, 4.0), ("1.3 Unit", 1.3, 1.3), ("Units", 0.0, 0.0)])
def test_units(spark, text, low, high):
    got = spark.range(1).select(*[c.cast("double") for c in catalogue.unit_range(F.lit(text))]).first()
    assert tuple(got) == (low, high)


def test_sections(spark):
    raw = spark.createDataFrame(
        [("00123", "30", "5", "off (7)", "12", "n/a", "30", "31", None), ("7", "30", "5", "n/a", "", None, "", "x", "NewOnly")],
        "section_code string, max_capacity string, requested string, waitlist string, waitlist_cap string, reserved string,"
        "section_enrolled string, total_enrolled string, status string")
    got = [tuple(r) for r in listings.normalize_sections(raw).orderBy("section_code").collect()]
    assert got == [(7, 30, 5, -1, -1, -1, -1, -1, "NewOnly"), (123, 30, 5, 7, 12, -1, 30, 31, "FULL")]


def test_exams(spark):
    raw = spark.createDataFrame([(1, "2025", "", "R 1"), (2, "2025", "TBA", "R 1"), (3, "2025", "Wed Dec 10 8:00-10:00am @A 1, B 2", "R 1"),
                                 (4, "2025", "Fri Mar 21 4:00-6:00pm", "R 1")], "k int, year string, exam string, room string")
    got = [r.exam_info for r in listings.normalize_exams(raw, first_building="room").orderBy("k").collect()]
    assert [g.status for g in got] == ["NO_FINAL", "TBA_FINAL", "SCHEDULED_FINAL", "SCHEDULED_FINAL"]
    dec = got[2].scheduled
    assert (dec.day_of_week, dec.month, dec.day, tuple(dec.start_time), tuple(dec.end_time), dec.buildings) == (
        "Wed", 11, 10, (8, 0), (10, 0), ["A 1", "B 2"])
    assert got[3].scheduled.buildings == ["R 1"] and tuple(got[3].scheduled.start_time) == (16, 0)


def test_restrictions_and_tutoring(spark):
    df = spark.createDataFrame([("A and L or X",)], "restrictions string")
    got = listings.restriction_flags(df).first().asDict()
    assert [k for k, v in got.items() if v is True] == ["r_a", "r_l", "r_x"]
    cards = spark.createDataFrame(
        [("I&C SCI 45C (same as CSE 45C) - LARC (Programming)", "Mon/Wed", "11:00 AM-12:50 PM", "Online")],
        "header string, days string, time string, building string")
    r = listings.normalize_tutoring(cards).first()
    assert (r.department, r.course_number, r.days, r.time, r.building) == ("I&C SCI", "45C", "MW", "11:00a-12:50p", "ON LINE")
    assert (r.start_minute, r.end_minute, r.meets_m, r.meets_w, r.meets_f) == (660, 770, True, True, False)


def test_catalogue_from_html(spark):
    html = ('<div class="courseblock"><span class="text detail-code"><strong>I&amp;C SCI 45C.</strong></span>'
            '<span class="text detail-title">Programming in C/C++.</span><span class="detail-hours_html">4 Units.</span>'
            '<div class="courseblockextra"><p>An introduction.</p></div><p class="detail-prereqs">Prerequisite: I&amp;C SCI 33.</p>'
            '<p class="detail-gened">(II and Vb ).</p></div>')
    pages = spark.createDataFrame([("I&C SCI", html + html.replace("45C", "46").replace("<p>An", "<div>Deep</div><p>An"))], "department string, html string")
    courses, rejected = catalogue.extract_catalogue(catalogue.course_blocks(pages, "department", "html"))
    assert [(r.course_id, r.description) for r in courses.orderBy("course_id").collect()] == [
        ("I&CSCI45C", "An introduction."), ("I&CSCI46", "DeepAn introduction.")]
    courses = courses.orderBy("course_id")
    r = courses.first()
    assert (r.course_id, r.course_number, r.course_numeric, r.course_level, r.title) == (
        "I&CSCI45C", "45C", 45, "LowerDiv", "Programming in C/C++")
    assert (r.prerequisite_text, r.description, r.ge_2, r.ge_5b, r.ge_1a) == ("I&C SCI 33", "An introduction.", True, True, False)
    assert rejected.count() == 0


def test_prerequisite_tree(spark, rows):
    raw = spark.createDataFrame([("X", "A 1 ( min grade = C ) AND ( B 2 OR B 3 )"), ("Y", "NO D 4 AND COMPAND 1"), ("Z", "???")], "k string, t string")
    trees, edges = catalogue.prereq_tables(raw, "k", "t")
    assert rows(edges) == [("X", "A1"), ("X", "B2"), ("X", "B3"), ("Y", "COMPAND1")]
    tree = {r.k: r for r in trees.collect()}
    assert [[(x.name, x.min_grade) for x in g] for g in tree["X"].groups] == [[("A 1", "C")], [("B 2", None), ("B 3", None)]]
    assert [x.name for x in tree["Y"].excluded] == ["D 4"] and tree["Z"].groups == []


def test_alias_patch_once(spark):
    raw = spark.createDataFrame([("X", "( K 32A OR B 3 ) AND C 1"), ("Y", "( K 32A OR K H32 )")], "k string, t string")
    trees, _ = catalogue.prereq_tables(raw, "k", "t")
    once = catalogue.patch_alias(trees, "K 32A", "K H32")
    for df in (once, catalogue.patch_alias(once, "K 32A", "K H32")):
        names = {r.k: [[x.name for x in g] for g in r.groups] for r in df.collect()}
        assert names == {"X": [["K 32A", "B 3", "K H32"], ["C 1"]], "Y": [["K 32A", "K H32"]]}


def test_calendar_without_summer_rows(spark):
    text = "Instruction begins\nSep 25\nJan 6\nMar 31\nInstruction ends\nDec 5\nMar 14\nJun 6\nFinal Examinations\nDec 6-12\nMar 15-21\nJun 7-12"
    df = spark.createDataFrame([(1, 2025, text)], "k int, y int, t string")
    got = {r.quarter: r for r in calendar.calendar_terms(df, "k", "y", "t").collect()}
    assert str(got["Fall"].instruction_start) == "2025-09-25" and str(got["Fall"].finals_end) == "2025-12-12"
    assert got["Winter"].year == "2026" and str(got["Winter"].instruction_start) == "2026-01-06"
    assert got["Fall"].soc_available is None


def test_opening_hours(spark):
    df = spark.createDataFrame([("Mo-Fr 07:15-11:00; Sa-Su 09:00-11:00",), ("",), ("Mo-Fr off",), ("junk",)], "h string")
    got = {r.h: r for r in dining.expand_hours(df, "h").collect()}
    full = got["Mo-Fr 07:15-11:00; Sa-Su 09:00-11:00"]
    assert (full.open_mo, full.close_fr, full.open_sa, full.close_su) == ("07:15", "11:00", "09:00", "11:00")
    for text in ("", "Mo-Fr off", "junk"):
        assert all(v is None for k, v in got[text].asDict().items() if k != "h")


def test_schedule_periods_skip_unknown_names(spark, rows):
    schedules = spark.sql("SELECT 1 schedule_id, array(named_struct('period','Lunch','hours','Mo-Fr 11:00-14:00'), named_struct('period','??','hours','')) meal_periods")
    periods = spark.createDataFrame([("Lunch", 7, 1)], "period string, period_id int, position int")
    assert rows(dining.schedule_periods(schedules, periods), "schedule_id", "period_id", "open_we", "open_su") == [(1, 7, "11:00", None)]


def test_events_localize(spark):
    ev = spark.createDataFrame([("p", "A", "2024-07-01", "12:00:00", None, "13:00:00", 1), ("p", "Renamed", "2024-07-01", "12:00:00", None, "13:00:00", 2),
                                ("p", "Week", None, None, None, None, 3), ("p", "Week", None, None, None, None, 4)],
                               "place string, title string, start_date string, start_time string, end_date string, end_time string, pos int")
    images = spark.createDataFrame([("Week", "img", 1)], "title string, image string, image_pos int")
    got = sorted(dining.localize_events(ev, images, "America/Los_Angeles").collect(), key=lambda r: r.pos)
    assert [(r.title, str(r.starts), str(r.ends), r.image) for r in got] == [
        ("Renamed", "2024-07-01 19:00:00", "2024-07-01 20:00:00", None), ("Week", "None", "None", "img")]


def test_slots(spark, rows):
    windows = spark.sql("SELECT 'r' room, 's' service, 'AVAILABLE' status, TIMESTAMP_NTZ '2024-01-01 09:00:00' opens, TIMESTAMP_NTZ '2024-01-01 10:00:00' closes "
                        "UNION ALL SELECT 'r', 's', 'AVAILABLE', TIMESTAMP_NTZ '2024-01-02 09:00:00', TIMESTAMP_NTZ '2024-01-02 09:20:00'")
    services = spark.createDataFrame([("s", "PT30M")], "service string, duration string")
    got = rooms.slots_from_windows(windows, services, "2023-01-01 00:00:00")
    assert [str(s.starts)[11:16] for s in got.orderBy("starts").collect()] == ["09:00", "09:15", "09:30"]


def test_room_page(spark):
    df = spark.createDataFrame([(" Room 192A (Tech Enhanced)\n (Main Library)\n Capacity: 4", "Go left", "Nice ,room\n\nWith light . .")],
                               "header string, directions string, description string")
    r = rooms.extract_rooms(df).first()
    assert (r.name, r.tech_enhanced, r.location, r.capacity, r.directions) == ("Room 192A", True, "Main Library", 4, "Go left.")
    assert r.description == "Nice, room, With light."


ROOM = """<h1 id="s-lc-public-header-title"> Room 5\n (Tech Enhanced)\n ({where})\n Capacity: 12 </h1>
<div class="s-lc-section-directions"><h2>Way</h2><p> Go left</p><p> and up </p></div><div class="x s-lc-section-description">{text}</div>"""


def test_room_pages(spark):
    plain = "Bright <b>no</b> room<br><br>with <p>a desk,<em>two</em></p><ul><li>A <b>screen</b><li> Chairs .</ul><div>left out</div><span>end</span>"
    listed = "<div><p>Rules:</p><p>No food\nNo drink</p></div><p>Ask the desk .</p><p> </p>"
    pages = spark.createDataFrame([(1, "u", ROOM.format(where="Main", text=plain)), (2, "v", ROOM.format(where=rooms.BY_PARAGRAPH, text=listed)),
                                   (3, "w", "<p>nothing</p>"), (4, "x", '<h1 id="s-lc-public-header-title">Odd</h1>')], "k int, url string, html string")
    got = {r.k: r for r in rooms.room_pages(pages.drop("html"), markup.elements(pages, "k", "html", True), "k").collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].name, got[1].tech_enhanced, got[1].location, got[1].capacity, got[1].directions) == ("Room 5", True, "Main", 12, "Go left and up.")
    assert got[1].description == "Bright room, , with a desk, two - A screen - Chairs. end." and got[1].url == "u"
    assert got[2].description == "Rules: No food, No drink. Ask the desk ."
    assert (got[4].name, got[4].description, got[4].capacity) == ("Odd", "", 0)


def test_space_slots(spark):
    spaces = spark.createDataFrame([("r", "2024-05-01 09:00:00", "2024-05-01 09:30:00", None), ("r", "2024-05-01 09:30:00", "2024-05-01 10:00:00", "taken")],
                                   "room string, starts string, ends string, class_name string")
    assert [(str(r.starts), r.is_available) for r in rooms.space_slots(spaces).orderBy("starts").collect()] == [
        ("2024-05-01 09:00:00", True), ("2024-05-01 09:30:00", False)]


def _grid(years=True):
    head = '<tr class="plangridyear"><th colspan=3>{}</th></tr><tr class="plangridterm"><th>Fall</th><th>Winter</th></tr>'
    rows = "<tr><td>A 1<sup>2</sup></td><td> B&amp;C  2 </td><td></td></tr><tr><td></td><td></td><td></td></tr>"
    return '<table class="x sc_plangrid"><tr class="plangridyear"><th> </th></tr>' + "".join(
        (head.format(y) if years else "") + rows for y in ("Freshman", "Sophomore")[:2 if years else 1]) + "</table>"


def test_program_grids(spark):
    one = f'<p>x</p><div id="sampleprogramtextcontainer"><h4>For Juniors</h4>{_grid(False)}<p>NOTES: First.</p><p>Second</p><ol><li>Third<li>Fourth</ol><h3>End</h3><p>no</p></div>'
    two = (f'<div id="sampleprogramtextcontainer"><h3>Sample Program — General</h3>{_grid()}<dl class="sc_footnotes"><dt>1</dt><dd><p>Foot</p></dd></dl>'
           f"<p>Special track</p>{_grid()}<table><tr><td>other</td></tr></table></div>{_grid()}")
    foot = f'<div id="sampleprogramtextcontainer">{_grid()}<dl class="sc_footnotes"><dd>Only foot</dd></dl></div>'
    star = f'<div id="sampleprogramtextcontainer">{_grid()}<p>* starred</p><p>plain</p><p>2. counted</p></div>'
    pages = spark.createDataFrame([(1, one), (2, two), (3, foot), (4, star), (5, "<table class=sc_plangrid></table>")], "k int, html string")
    rows, variations = grids.program_grids(sinks.keep(markup.elements(pages, "k", "html", True), "elements"), "k")
    of = {}
    for r in rows.orderBy("k", "grid", "pos").collect():
        of.setdefault(r.k, []).append(r.header or list(r.cells))
    cells = ["A 1", "B&C 2", ""]
    assert of[1] == ["Junior", cells] and of[3] == ["Freshman", cells, "Sophomore", cells] and of[2] == of[3] * 2
    assert [(r.k, r.label, r.notes) for r in variations.orderBy("k", "grid").collect()] == [
        (1, None, ["First.", "Second", "Third", "Fourth"]), (2, "General", ["Foot"]), (2, "Special track", []), (3, None, ["Only foot"]),
        (4, None, ["* starred", "2. counted"])]
    terms = grids.grid_to_terms(rows.where("k = 3"), "k", "pos", "header", "cells", F.lit(0)).orderBy("year").collect()
    assert [(t.year, t.fall, t.winter, t.spring) for t in terms] == [("Freshman", ["A 1"], ["B&C 2"], []), ("Sophomore", ["A 1"], ["B&C 2"], [])]


def _term(spark):
    return spark.sql("SELECT '2025' year, 'Fall' quarter, DATE '2025-09-25' instruction_start, DATE '2025-12-05' instruction_end,"
                     " DATE '2025-12-06' finals_start, DATE '2025-12-12' finals_end")


def test_weeks(spark):
    dates = spark.sql("SELECT explode(array(DATE '2025-09-28', DATE '2025-09-29', DATE '2025-12-08', DATE '2026-08-01')) d")
    got = {str(r.d): (r.weeks, r.quarters, r.display) for r in temporal.week_of_term(dates, _term(spark), "d").collect()}
    assert got["2025-09-28"][0] == [0] and got["2025-09-29"][0] == [1]
    assert got["2025-12-08"] == ([-1], ["Fall Quarter 2025"], "Finals Week • Fall Quarter 2025. Good luck! 🤞")
    assert got["2026-08-01"] == ([-1], ["N/A"], "Enjoy your break! 😎")


def test_names(spark):
    directory = spark.createDataFrame(
        [("a", "John Adam Smith", "Professor of X", False), ("b", "Jane Smith", "Staff", False), ("c", "Maria De La Cruz", "Lecturer", False),
         ("d", "Max Featherstonehaughs", "Staff", False), ("e", "Stu Dent", "None", True), ("f", "Jo O&#39;Neil", "Staff", False)],
        "person_id string, full_name string, title string, is_student boolean")
    names = spark.createDataFrame([(n,) for n in ("SMITH, J.", "SMITH, J.A.", "DE LA CRUZ, M.", "FEATHERSTONEHA, M.", "DENT, S.", "NOBODY, X.", "O'NEIL, J.", "SMITH")], "name string")
    got = {r.name: r.person_id for r in people.resolve_names(names, directory).collect()}
    assert got == {"SMITH, J.": "a", "SMITH, J.A.": "a", "DE LA CRUZ, M.": "c", "FEATHERSTONEHA, M.": "d",
                   "DENT, S.": "student", "NOBODY, X.": None, "O'NEIL, J.": "f", "SMITH": "a"}


def test_directory_redacts_students(spark):
    raw = spark.createDataFrame([("x1", "JO B", "YUBiLm9yZw==", "D &amp; E", "T", None), ("x2", "S T", "YUBiLm9yZw==", "D", "T", "Senior")],
                                "person_id string, name string, email string, department string, title string, student_level string")
    got = sorted(tuple(r) for r in people.clean_directory(raw).collect())
    assert got[1] == ("x1", "Jo B", "a@b.org", "D & E", "T") and got[0][:2] == ("student", "REDACTED REDACTED")


def test_patterns(spark, rows):
    catalogue_rows = spark.createDataFrame(
        [("D1", "D", "1", 1), ("D10", "D", "10", 10), ("D100", "D", "100", 100), ("D150B", "D", "150B", 150), ("DH2", "D", "H2", 2), ("E1", "E", "1", 1)],
        "course_id string, shortened_dept string, course_number string, course_numeric int")

    def hits(pattern):
        df = spark.createDataFrame([("r", pattern)], "r string, pattern string")
        return [c for _, c in rows(programs.expand_patterns(df, catalogue_rows, ["r"]))]

    assert hits("D @") == ["D1", "D10", "D100", "D150B", "DH2"]
    assert hits("D 1@") == ["D10", "D100", "D150B"] and hits("D 1@@") == ["D100", "D150B"]
    assert hits("D 100-199") == ["D100", "D150B"] and hits("D 100A-120") == ["D100"]
    assert hits("D H2") == ["DH2"] and hits("ELECTIVE @") == [] and hits("E 9") == []


def test_constraints(spark):
    def clause(connector, code, op, *values):
        return (connector, code, op, list(values))

    cases = [([], "always"), ([clause("", "DWCREDITS", ">=", "4")], "sometimes"), ([clause("", "DWCREDITS", ">=", "2")], "always"),
             ([clause("", "DWCREDITS", ">", "4")], "never"), ([clause("", "DWTERM", "=", "2024 FALL")], "sometimes"),
             ([clause("", "DWTERM", ">", "2030 FALL"), clause("OR", "DWCREDITS", "<", "9")], "always"),
             ([clause("", "DWCREDITS", "<", "9"), clause("AND", "DWTERM", ">", "2030 FALL")], "never"),
             ([clause("", "DWOTHER", "=", "x")], "always")]
    df = spark.createDataFrame([(i, 2, 4, c) for i, (c, _) in enumerate(cases)],
                               "i int, lo int, hi int, c array<struct<connector:string,code:string,operator:string,values:array<string>>>")
    got = {r.i: r.match for r in rules.classify_constraints(df, "c", "lo", "hi", "20242025").collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    inverted = {r.i: r.x for r in df.select("i", rules.invert_exclusion("c").alias("x")).collect()}
    assert inverted[1][0].operator == "<" and inverted[4] == [] and inverted[5] is None and inverted[0] is None


def test_specialization_advice(spark):
    def need(part, *advice):
        df = spark.createDataFrame([([(part, list(advice))],)], "r array<struct<if_else_part:string,advice:array<string>>>")
        return df.select(rules.needs_specialization("r")).first()[0]

    assert need("ElsePart", "Please choose an Emphasis") is True
    assert need("IfPart", "Please choose an Emphasis") is False
    assert need("ElsePart", *rules.NOT_REQUIRED_ADVICE) is False


def _nested(depth: int, leaf: str) -> str:
    doc = leaf
    for i in range(depth - 1):
        doc = f'{{"ruleType":"Group","label":"L [ \\"{i}","requirement":{{"numberOfGroups":"1"}},"ruleArray":[{doc}]}}'
    return f"[{doc}]"


def test_rules_of_any_depth(spark):
    def course(number):
        return ('{"ruleType":"Course","label":"C","requirement":{"classesBegin":"1","courseArray":'
                f'[{{"discipline":"X","number":"{number}"}}]}}}}')

    docs = [(d * 10 + n, _nested(d, course(n))) for d in (1, 2, 5, 8) for n in (1, 2)]
    condition = course(3)
    for _ in range(3):
        condition = f'{{"ruleType":"IfStmt","requirement":{{"ifPart":{{"ruleArray":[{condition}]}}}}}}'
    audits = spark.createDataFrame([*docs, (99, f"[{condition}]"), (100, "[]"), (101, None)], "k int, d string").select(
        "k", F.parse_json("d").alias("rules"))
    got = {}
    for r in rules.requirement_nodes(audits, "k", "rules").collect():
        got.setdefault(r.k, []).append((r.path, r.kind, r.requirement_id))
    assert {k: len(v) for k, v in got.items()} == {**{d * 10 + n: d for d in (1, 2, 5, 8) for n in (1, 2)}, 99: 1}
    roots = [min(v)[2] for k, v in got.items() if k < 99]
    assert len(set(roots)) == len(roots) == 8
    assert rules.requirement_nodes(audits.where("k < 0"), "k", "rules").count() == 0


def test_first_matching_block(spark):
    doc = '[{"requirementType":"OTHER","requirementValue":"1","n":0},{"requirementType":"MAJOR","requirementValue":"201","n":1},{"requirementType":"MAJOR","requirementValue":"201","n":2}]'
    audits = spark.createDataFrame([(1, doc, "201")], "k int, d string, m string").withColumn("blocks", F.parse_json("d"))
    got = rules.first_block(audits, ["k"], "blocks", "MAJOR", F.col("m")).select(F.try_variant_get("block", "$.n", "int")).first()[0]
    assert got == 1


def test_grid(spark, rows):
    data = [("p", 0, None, ["before", "", ""]), ("p", 1, "Freshman", None), ("p", 2, None, ["A  1", "B 2", ""]), ("p", 3, None, ["", "", " "]),
            ("p", 4, None, ["C 3"]), ("p", 5, " Sophomore ", None), ("p", 6, None, ["", "D 4", "E 5"])]
    df = spark.createDataFrame(data, "prog string, pos long, h string, cells array<string>")
    got = grids.grid_to_terms(df, "prog", "pos", "h", "cells", F.floor(F.col("pos") / 2))
    assert rows(got.drop("prog", "page")) == [
        (-1, "Freshman", ["before"], [], []), (1, "Freshman", ["A 1", "C 3"], ["B 2"], []), (5, "Sophomore", [], ["D 4"], ["E 5"])]
    headings = spark.createDataFrame([("Sample for Juniors", "/a/b_bs/"), ("?", "/x")], "t string, u string")
    assert rows(headings.select(grids.heading_year("t"), grids.program_id("u"))) == [("Freshman", "x"), ("Junior", "b_bs")]


def test_zip_reports_uneven_arrays(spark):
    raw = spark.createDataFrame([(1, ["a", "b"], ["-SL-1", "2"]), (2, ["a"], [])], "k int, ids array<string>, codes array<string>")
    labels = spark.createDataFrame([("2", "Main", "Floor 2")], "floor_code string, main_label string, sub_label string")
    located, uneven = occupancy.zip_locations(raw, labels, "ids", "codes")
    assert sorted((r.location_id, r.place, r.location) for r in located.collect()) == [
        ("a", "Science Library", "Unknown"), ("b", "Langson Library", "Main - Floor 2")]
    assert [r.k for r in uneven.collect()] == [2]


def test_credit_rules_last_reward_wins(spark, rows):
    raw = spark.sql("SELECT 'CALC' exam, 'Calculus' catalogue_name, array(named_struct('scores', array(3,4), 'units', 4, 'elective_units', 0, 'ge', map('GE-2', 1), 'courses', '{}'),"
                    " named_struct('scores', array(4,5), 'units', 8, 'elective_units', 0, 'ge', map('GE-3', 2), 'courses', '{}')) rewards")
    tables = programs.load_credit_rules(raw)
    joined = tables["score"].join(tables["reward"].drop("exam"), "reward_id")
    assert rows(joined, "score", "units", "ge_2", "ge_3") == [(3, 4, 1, 0), (4, 8, 0, 2), (5, 8, 0, 2)]

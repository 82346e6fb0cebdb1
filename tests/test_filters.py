import pytest
from pyspark.sql import functions as F

from quadlake.functions import filters as flt
from quadlake.functions import project as prj


def test_number_list_forms():
    assert flt.split_number_list("46,6B,51-53") == [("int", 46), ("text", "6B"), ("range", (51, 53))]
    with pytest.raises(ValueError):
        flt.split_number_list("5A-9")


def test_day_names():
    assert flt.split_days("Mon,W,Thur,Fr") == ["M", "W", "Th", "F"]
    with pytest.raises(ValueError):
        flt.split_days("Moon")


@pytest.mark.parametrize("text,minute", [("2:00pm", 840), ("14:00", 840), ("12:15 am", 15), ("12:00p", 720)])
def test_minute_of_day(text, minute):
    assert flt.minute_of_day(text) == minute


@pytest.mark.parametrize("text", ["25:00", "13:00pm", "noon", "9:75"])
def test_minute_of_day_rejects(text):
    with pytest.raises(ValueError):
        flt.minute_of_day(text)


def test_zero_is_a_bound(spark, rows):
    df = spark.createDataFrame([(0, 0), (1, 2)], "lo int, hi int")
    assert rows(df.where(flt.unit_bounds("lo", "hi", hi=0))) == [(0, 0)]
    assert flt.unit_bounds("lo", "hi") is None


def test_status_null_drops(spark, rows):
    df = spark.createDataFrame([("OPEN", 1, 1, 5), (None, 9, 1, 5), ("FULL", 1, 9, 5), ("Waitl", 1, 1, 5)],
                               "s string, e int, t int, c int")

    def hits(mode):
        return rows(df.where(flt.fill_status(mode, "s", "e", "t", "c")), "s")

    assert hits("SkipFull") == [("OPEN",), ("Waitl",)]
    assert hits("SkipFullWaitlist") == [("OPEN",)]
    assert hits("FullOnly") == [("FULL",), ("Waitl",)]
    assert set(hits("Overenrolled")) == {("FULL",), (None,)}


def test_variable_units(spark, rows):
    df = spark.createDataFrame([("4",), ("1-4",)], "u string")
    assert rows(df.where(flt.units_is("u", "VAR"))) == [("1-4",)]
    assert rows(df.where(flt.units_is("u", "4"))) == [("4",)]


def test_level_band_lower(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (99,), (100,), (200,)], "n int")
    assert rows(df.where(flt.level_band("n", "LowerDiv"))) == [(1,), (99,)]
    assert rows(df.where(flt.level_band("n", "LowerDiv", lower=0))) == [(0,), (1,), (99,)]
    assert rows(df.where(flt.level_band("n", "Graduate"))) == [(200,)]


def test_umbrella_and_lookup(spark, rows):
    assert flt.expand_umbrella("Summer") == ["Summer1", "Summer10wk", "Summer2"]
    assert flt.expand_umbrella("Fall") == ["Fall"]
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(flt.lookup(df, "k", 2)) == [(2,)]
    assert rows(flt.lookup(df, "k", [1, 3])) == [(1,), (3,)]
    assert rows(flt.lookup(df, "k", df.where("k > 1").union(df))) == [(1,), (2,), (3,)]
    assert rows(flt.lookup(df, "k", list(range(10)), in_filter=5)) == rows(flt.lookup(df, "k", list(range(10))))


def test_display_forms(spark, rows):
    df = spark.createDataFrame([(123, -1), (1234567, 4)], "code int, w int")
    assert rows(df.select(prj.pad_code("code"), prj.count_text("w"))) == [("00123", ""), ("1234567", "4")]


def test_projection_helpers(spark, rows):
    df = spark.createDataFrame([("I&C SCI", "H45C", 1570, None, True, False, 3, 0)],
                               "d string, n string, m int, t string, x boolean, y boolean, p int, q int")
    got = df.select(
        prj.compact_id("d", "n"), prj.digits_or_zero("n"), prj.hour_minute("m"), prj.impute_flag("t", ["x"]),
        prj.flags_to_list({"X": "x", "Y": "y"}), prj.positive_map({"p": "p", "q": "q"}),
        prj.term_id("n", "d")).first()
    assert got[0] == "I&CSCIH45C" and got[1] == 45 and tuple(got[2]) == (26, 10) and got[3] is False
    assert got[4] == ["X"] and got[5] == {"p": 3} and got[6] == "H45C I&C SCI"


def test_open_ranges_always_stay(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2024-01-01', NULL), (2, DATE '2024-01-01', DATE '2024-01-05'),"
                   "(3, DATE '2024-02-01', DATE '2024-02-05') AS t(k, a, b)")
    assert rows(df.where(flt.overlaps_open("a", "b", after="2024-01-04")), "k") == [(1,), (2,), (3,)]
    assert rows(df.where(flt.overlaps_open("a", "b", as_of="2024-01-20")), "k") == [(1,), (3,)]
    assert rows(df.where(flt.overlaps_open("a", "b", before="2024-01-10")), "k") == [(1,), (2,)]


def test_term_bounds(spark, rows):
    df = spark.createDataFrame([("2023", "Fall"), ("2024", "Winter"), ("2024", "Summer2"), ("2025", "Winter")],
                               "y string, q string")
    where = flt.term_between("y", "q", since=("2024", "Spring"), until=("2025", None))
    assert rows(df.where(where)) == [("2024", "Summer2"), ("2025", "Winter")]


def test_ids_of_known_payload(spark):
    got = spark.range(1).select(prj.content_id(F.lit("a"))).first()[0]
    assert got == "DMF1ucDxtq"

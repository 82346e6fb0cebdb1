"""Academic calendar text to term dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed, parsing

# Label patterns of the calendar rows.
LABELS = {
    "soc_available": "(?i)schedule of classes available",
    "instruction_start": "(?i)instruction begins",
    "instruction_end": "(?i)instruction ends",
    "finals": "(?i)final examinations",
}


def calendar_terms(pages: DataFrame, key: str, year: str, text: str) -> DataFrame:
    """One row per (page, term): the dates of the six terms that start in autumn `year`.

    The three cells after the first line with a label belong to autumn, winter and
    spring, those after the last such line to the summer sessions. A page has a few
    dozen lines, so it is handled in its own row, without a shuffle.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    base = pages.select(key, F.col(year).cast("int").alias("_y"), lines.alias("_l"))

    def positions(pattern: str) -> Column:
        return F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())

    def cells(pattern: str) -> Column:
        first = F.coalesce(F.get(positions(pattern), F.lit(0)), F.lit(0))
        last = F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), positions(pattern)), -1), F.lit(0))
        return F.concat(F.slice("_l", first + 1, 3), F.slice("_l", last + 1, 3))

    with_cells = base.withColumns({f"_{n}": cells(p) for n, p in LABELS.items()})
    terms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("quarter"))
                      for i, q in enumerate(fixed.CALENDAR_TERMS)])
    rows = with_cells.withColumn("t", F.explode(terms))

    def cell(name: str) -> Column:
        return F.get(F.col(f"_{name}"), F.col("t.i"))

    def date(text_: Column, later_from: int) -> Column:
        y = F.col("_y") + F.when(F.col("t.i") > later_from, 1).otherwise(0)
        month = parsing.month_number(F.substring_index(text_, " ", 1))
        day = parsing.extract_int(text_, r"^\S+ (\d+)")
        return parsing.civil_date(y, month, day)

    range_text = F.regexp_replace(cell("finals"), "–", "-")
    head, tail = F.substring_index(range_text, "-", 1), F.substring_index(range_text, "-", -1)
    month_name = F.substring_index(head, " ", 1)
    last = F.when(tail.rlike("[A-Za-z]"), tail).otherwise(F.concat_ws(" ", month_name, tail))
    return rows.select(
        key, (F.col("_y") + F.when(F.col("t.i") > 0, 1).otherwise(0)).cast("string").alias("year"),
        F.col("t.quarter").alias("quarter"),
        date(cell("instruction_start"), 0).alias("instruction_start"),
        date(cell("instruction_end"), 0).alias("instruction_end"),
        date(head, 0).alias("finals_start"), date(last, 0).alias("finals_end"),
        # Autumn and winter schedules both come out in the first calendar year.
        date(cell("soc_available"), 1).alias("soc_available"))

"""Tabular imports: grade files and course-material files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.operators.upsert import last_wins

# Column names of the two file kinds.
GRADE_COLUMNS = (
    "CalYr", "AcadTerm", "CourseCode", "GradeACount", "GradeBCount", "GradeCCount", "GradeDCount",
    "GradeFCount", "GradePCount", "GradeNPCount", "GradeWCount",
)
MATERIAL_COLUMNS = ("Term", "Dept/Course", "Course Code", "Title", "Author", "Edition", "ISBN", "Format", "Req/Rec",
                    "MMS ID", "Link")
MATERIAL_REQUIREMENTS = {"Go to Class First": "GoToClassFirst"}


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV export with a header; all columns as text, so nothing is inferred."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def import_tabular(raw: DataFrame, required: Sequence[str], key: Sequence[str], order: Sequence[str]
                   ) -> tuple[DataFrame, DataFrame]:
    """(last row per key, rows with a missing required value); blank rows vanish."""
    require_columns(raw, required)

    def blank(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return text.isNull() | (F.trim(text) == "")

    empty = reduce(lambda a, b: a & b, [blank(c) for c in required])
    partial = reduce(lambda a, b: a | b, [blank(c) for c in required])
    whole = last_wins(raw.where(~partial), key, order)
    return whole, raw.where(partial & ~empty)


def split_last_space(col: str, head: str, tail: str) -> dict[str, Column]:
    """'I&C SCI 45C' -> ('I&C SCI', '45C')."""
    text = F.trim(F.col(col))
    last = F.substring_index(text, " ", -1)
    return {head: F.trim(F.left(text, F.length(text) - F.length(last))), tail: last}


def import_materials(raw: DataFrame, term: str, course: str, code: str, form: str, requirement: str,
                     requirements: Mapping[str, str] = MATERIAL_REQUIREMENTS) -> DataFrame:
    """Split the term and course columns, rename requirements, leave out rows without a code.

    Empty formats and requirements are unknown (null); other columns stay as they are.
    """
    renamed = F.create_map(*[F.lit(x) for pair in requirements.items() for x in pair])
    wanted = F.nullif(F.col(requirement), F.lit(""))
    return (raw.where(F.col(code).isNotNull() & (F.trim(F.col(code).cast("string")) != ""))
            .withColumns({
                "quarter": F.split_part(F.trim(term), F.lit(" "), F.lit(1)),
                "year": F.split_part(F.trim(term), F.lit(" "), F.lit(2)),
                **split_last_space(course, "department", "course_number"),
                "format": F.nullif(F.col(form), F.lit("")),
                "requirement": F.coalesce(F.try_element_at(renamed, wanted), wanted),
            }))

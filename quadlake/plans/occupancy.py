"""Occupancy feeds: location metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks in floor codes, in order of precedence, and the last resort.
CODE_MARKS = {"GSC": "Gateway Study Center", "-SL-": "Science Library"}
OTHER_PLACE = "Langson Library"


def zip_locations(raw: DataFrame, labels: DataFrame, ids: str, codes: str) -> tuple[DataFrame, DataFrame]:
    """Parallel id and floor-code arrays to (location rows, rows with unequal arrays)."""
    even = F.size(ids) == F.size(codes)
    rest = [c for c in raw.columns if c not in (ids, codes)]
    pairs = (raw.where(even)
             .select(*rest, F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(codes).alias("code"))).alias("z"))
             .select(*rest, F.col("z.id").alias("location_id"), F.col("z.code").alias("floor_code")))
    place = F.lit(OTHER_PLACE)
    for mark, name in reversed(CODE_MARKS.items()):
        place = F.when(F.col("floor_code").contains(mark), name).otherwise(place)
    named = pairs.withColumn("place", place).join(labels, "floor_code", "left")
    label = F.when(F.coalesce("sub_label", F.lit("")) != "", F.concat_ws(" - ", "main_label", "sub_label")).otherwise(
        F.coalesce(F.nullif("main_label", F.lit("")), F.lit("Unknown")))
    return named.withColumn("location", label).drop("main_label", "sub_label"), raw.where(~even)

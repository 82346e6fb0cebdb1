"""Dining feeds: opening hours, menus, periods and events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed, parsing
from quadlake.operators.upsert import last_wins


def expand_hours(df: DataFrame, col: str) -> DataFrame:
    """'Mo-Fr 07:15-11:00; Sa-Su off' to open_su, close_su, ..., open_sa, close_sa.

    Later blocks win, ranges may wrap around the week, unreadable blocks count for
    nothing, "off" and days not mentioned stay null. Everything happens inside the row.
    """
    days = F.array(*[F.lit(d) for d in fixed.HOURS_DAYS])
    blocks = F.filter(F.transform(F.split(F.col(col), ";"), lambda b: F.trim(b)), lambda b: b != "")

    def parsed(block: Column) -> Column:
        parts = F.split(block, r"\s+")
        span, hours = parts[0], F.get(parts, F.lit(1))
        first = F.array_position(days, F.substring_index(span, "-", 1)) - 1
        last = F.array_position(days, F.split(span, "-")[F.when(span.contains("-"), 1).otherwise(0)]) - 1
        readable = hours.isNotNull() & (first >= 0) & (last >= 0) & ((hours == "off") | hours.contains("-"))
        return F.struct(
            F.coalesce(readable, F.lit(False)).alias("ok"), first.alias("first"), F.pmod(last - first, F.lit(7)).alias("span"),
            F.when(hours != "off", F.split(hours, "-")[0]).alias("opens"),
            F.when(hours != "off", F.get(F.split(hours, "-"), F.lit(1))).alias("closes"))

    base = df.withColumn("_b", F.filter(F.transform(blocks, parsed), lambda b: b["ok"]))
    out = {}
    for i, day in enumerate(fixed.HOURS_DAYS):
        out.update(_day_pair(day, i))
    return base.withColumns(out).drop("_b")


def _day_pair(day: str, index: int) -> dict[str, Column]:
    """Hours of the last block that covers the day."""
    covering = F.filter("_b", lambda b: F.pmod(F.lit(index) - b["first"], F.lit(7)) <= b["span"])
    last = F.get(covering, F.size(covering) - 1)
    return {f"open_{day.lower()}": last["opens"], f"close_{day.lower()}": last["closes"]}


def schedule_periods(schedules: DataFrame, periods: DataFrame) -> DataFrame:
    """Schedules (schedule_id, meal_periods array of struct(period, hours)) joined to the
    known periods (period, period_id, position) by name; unknown names are left out."""
    opened = schedules.select(*[c for c in schedules.columns if c != "meal_periods"],
                              F.explode("meal_periods").alias("m"))
    flat = opened.select(*[c for c in opened.columns if c != "m"], "m.period", "m.hours")
    return expand_hours(flat.join(periods, "period", "inner"), "hours")


# Numeric attributes of a dish and their columns.
NUTRITION = {
    "calories": "calories", "sodium": "sodium_mg", "total_fat": "total_fat_g", "trans_fat": "trans_fat_g",
    "saturated_fat": "saturated_fat_g", "sugars": "sugars_g", "iron": "iron_mg",
    "cholesterol": "cholesterol_mg", "total_carbohydrates": "total_carbs_g",
    "dietary_fiber": "dietary_fiber_g", "protein": "protein_g", "calcium": "calcium_mg",
    "vitamin_a": "vitamin_a_iu", "vitamin_c": "vitamin_c_iu",
}


def menu_tables(products: DataFrame, date_map: DataFrame, codes: Mapping[str, int]) -> dict[str, DataFrame]:
    """Menu feed to dish, nutrition, diet and menu tables.

    products: pos, sku, name, images array<string>, attributes array<struct(name, values
    array<string>)> (single values as lists of one). date_map: date, stations
    array<struct(id, skus array<string>)>. `codes` names the boolean column of each
    allergen or preference code. The last product wins per sku.
    """
    unique = last_wins(products, ["sku"], ["pos"])
    attrs = F.map_from_entries(F.transform("attributes", lambda a: F.struct(a["name"], a["values"])))
    wide = unique.withColumn("_a", attrs)

    def values(name: str) -> Column:
        return F.try_element_at("_a", F.lit(name))

    def text(name: str) -> Column:
        return F.get(values(name), F.lit(0))

    def listed(name: str) -> Column:
        return F.coalesce(F.transform(values(name), parsing.int_or_null), F.array(F.lit(0)))

    serving = F.split(text("serving_combined"), " ")
    all_codes = F.concat(listed("allergens_intolerances"), listed("recipe_attributes"))
    menu = (date_map.select("date", F.explode("stations").alias("s"))
            .select("date", F.col("s.id").alias("station_id"), F.explode("s.skus").alias("sku")))
    stations = menu.groupBy("sku").agg(F.max_by("station_id", F.struct("date", "station_id")).alias("station_id"))
    dishes = wide.select(
        "sku", "name", F.coalesce(text("marketing_description"), F.lit("")).alias("description"),
        F.coalesce(text("recipe_ingredients"), F.lit("")).alias("ingredients"),
        F.coalesce(text("master_recipe_type"), F.lit("")).alias("category"),
        F.nullif(F.trim(F.get("images", F.lit(0))), F.lit("")).alias("image_url"))
    return {
        # A sku on the menu without a product stays as an unidentified dish.
        "dish": stations.join(dishes, "sku", "left").withColumn(
            "name", F.coalesce("name", F.lit("UNIDENTIFIED"))),
        "nutrition": wide.select(
            "sku", *[text(a).try_cast("double").alias(c) for a, c in NUTRITION.items()],
            F.coalesce(serving[0], F.lit("")).alias("serving_size"),
            F.coalesce(F.get(serving, F.lit(1)), F.lit("")).alias("serving_unit")),
        "diet": wide.select("sku", *[F.array_contains(all_codes, code).alias(c) for c, code in codes.items()]),
        "menu": menu.distinct(),
    }


def image_address(url, base: str, skip: int = 36) -> Column:
    """Address of an event's image: behind a start of fixed length the feed's path begins with the image's id."""
    url = F.col(url) if isinstance(url, str) else url
    return F.concat(F.lit(base), F.substring_index(F.substr(url, F.lit(skip + 1)), "/", 1))


def localize_events(events: DataFrame, images: DataFrame, tz: str) -> DataFrame:
    """Local dates and times to UTC timestamps, images by title, one row per event.

    No time gives no timestamp; an end without a date ends on the start date. Events
    with a start are the same if place, start and end agree (a new title renames them),
    events without one if place and title agree; the later row wins.
    Columns: place, title, start_date, start_time, end_date, end_time, pos.
    """
    def utc(date: Column, time: Column) -> Column:
        local = F.concat_ws(" ", date, time).try_cast("timestamp")
        return F.when(date.isNotNull() & time.isNotNull(), F.to_utc_timestamp(local, tz)).cast("timestamp_ntz")

    timed = events.withColumns({
        "starts": utc(F.col("start_date"), F.col("start_time")),
        "ends": utc(F.coalesce("end_date", "start_date"), F.col("end_time"))})
    key = F.when(F.col("starts").isNull(), F.concat_ws("|", F.lit("title"), "title")).otherwise(
        F.concat_ws("|", F.lit("time"), F.col("starts").cast("string"),
                    F.coalesce(F.col("ends").cast("string"), F.lit(""))))
    unique = last_wins(timed.withColumn("_key", key), ["place", "_key"], ["pos"])
    last_image = images.groupBy("title").agg(F.max_by("image", "image_pos").alias("image"))
    return unique.join(last_image, "title", "left").drop("_key")

"""Dining, study rooms, occupancy and the calendar.

Tables and the columns read:
  event     restaurant, title, starts, ends, updated_at      station  restaurant, station_id, name
  dish      sku, station_id, name     nutrition, diet  sku, ...    served  restaurant, date, period_id, station_id, sku
  schedule  schedule_id, restaurant, name, kind, starts, ends
  period    schedule_id, period_id, position, open_*/close_* columns
  room      room, location, capacity, tech_enhanced, url    slot  room, starts, ends, available
  occupancy location_id, place, location, count, percentage, timestamp
  term      year, quarter, instruction_start/end, finals_start/end, soc_available
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import filters as flt
from quadlake.functions import fixed
from quadlake.functions.project import iso_day, room_url, slot_url, utc_text
from quadlake.operators import aggs, joins
from quadlake.operators.slices import id_block
from quadlake.operators.temporal import week_of_term

Tables = Mapping[str, DataFrame]


def _equal(col: str, value) -> Column | None:
    return None if value is None else F.col(col) == value


def dining_events(tables: Tables, as_of: str, restaurant: str | None = None, after: str | None = None,
                  before: str | None = None) -> DataFrame:
    where = flt.conjuncts(flt.current_or_recent("starts", "ends", "updated_at", as_of, after, before),
                          _equal("restaurant", restaurant))
    return tables["event"].where(where).orderBy(F.col("starts").asc_nulls_last())


def dishes(tables: Tables, skus) -> tuple[DataFrame, DataFrame]:
    """(dishes with nutrition and diet, dishes that miss one of the two)."""
    wanted = flt.lookup(tables["dish"], "sku", skus)
    return joins.require_one_to_one(wanted, "sku", {"nutrition": tables["nutrition"], "diet": tables["diet"]})


def dining_dates(tables: Tables, restaurant: str | None = None) -> DataFrame:
    """First and last day with a menu."""
    return aggs.date_range(tables["served"].where(flt.conjuncts(_equal("restaurant", restaurant))), "date")


def restaurants(tables: Tables, restaurant: str | None = None, page_size: int = 1000) -> DataFrame:
    """Restaurants with their stations."""
    stations = tables["station"].where(flt.conjuncts(_equal("restaurant", restaurant)))
    return aggs.nest(stations.select("restaurant").distinct(), stations, "restaurant", ["station_id"],
                     F.col("station_id"), F.struct("station_id", "name"), "stations", page_size)


def restaurant_day(tables: Tables, restaurant: str, date: str, page_size: int = 1000) -> DataFrame:
    """Per meal period of a day: map station -> dishes."""
    day = tables["served"].where((F.col("restaurant") == restaurant) & (F.col("date") == F.lit(date).cast("date")))
    return aggs.nest_map(day, "period_id", "station_id", "sku", F.substring("sku", 1, 4), "stations", page_size)


def schedules(tables: Tables, as_of: str, restaurant: str | None = None, after: str | None = None,
              before: str | None = None, include_past: bool = False, page_size: int = 1000) -> DataFrame:
    """Schedules with their meal periods in order and hours per weekday; standard ones first."""
    overlap = flt.overlaps_open("starts", "ends", after, before, None if include_past else as_of)
    chosen = tables["schedule"].where(flt.conjuncts(_equal("restaurant", restaurant), overlap))
    hours = F.struct(*[F.struct(F.col(f"open_{d.lower()}").alias("open"), F.col(f"close_{d.lower()}").alias("close"))
                       .alias(d.lower()) for d in fixed.HOURS_DAYS])
    nested = aggs.nest(chosen, tables["period"], "schedule_id", ["position", "period_id"], id_block("position", 64),
                       F.struct("period_id", "position", hours.alias("hours")), "periods", page_size)
    return nested.orderBy(F.when(F.col("kind") == "standard", 0).otherwise(1), F.col("starts").asc_nulls_first(),
                          "schedule_id", "page")


def study_rooms(tables: Tables, tz: str, bases: Mapping[str, str], default_base: str, *, room: str | None = None,
                location: str | None = None, capacity_min: int | None = None, capacity_max: int | None = None,
                tech_enhanced: bool | None = None, dates: Sequence[str] | None = None,
                times: Sequence[tuple[str, str]] | None = None, page_size: int = 1000) -> DataFrame:
    """Rooms with their slots by start; with slot filters only rooms and slots that match."""
    chosen = tables["room"].where(flt.conjuncts(
        _equal("room", room), _equal("location", location), flt.unit_bounds("capacity", "capacity", capacity_min, capacity_max),
        _equal("tech_enhanced", tech_enhanced)))
    slots = tables["slot"].where(flt.slot_overlap("starts", "ends", dates, times))
    linked = slots.join(chosen.select("room", "url", "location"), "room").select(
        "room", "starts", F.struct(
            utc_text("starts", tz, "+00:00").alias("start"), utc_text("ends", tz, "+00:00").alias("end"),
            slot_url("url", "location", "room", "starts", tz, bases, default_base).alias("url"),
            "available").alias("slot"))
    if dates or times:
        chosen = chosen.join(linked.select("room").distinct(), "room", "left_semi")
    nested = aggs.nest(chosen, linked, "room", ["starts"], F.col("starts").cast("date"), F.col("slot"), "slots", page_size)
    return nested.withColumn("url", room_url("url", "location", "room", bases, default_base))


def occupancy(tables: Tables, place: str | None = None, location: str | None = None) -> DataFrame:
    return tables["occupancy"].where(flt.conjuncts(_equal("place", place), _equal("location", location)))


def calendar(tables: Tables, year: str | None = None, quarter: str | None = None) -> DataFrame:
    """Dates of one term or of all."""
    rows = tables["term"].where(flt.conjuncts(_equal("year", year), _equal("quarter", quarter)))
    dates = ["instruction_start", "instruction_end", "finals_start", "finals_end", "soc_available"]
    return rows.select("year", "quarter", *[iso_day(d).alias(d) for d in dates])


def week(tables: Tables, dates: DataFrame, date: str) -> DataFrame:
    """Week, term and display text for each of the dates."""
    return week_of_term(dates, tables["term"], date)

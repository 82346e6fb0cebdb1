"""Time: daily snapshots, week of term, business hours, active terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.project import term_name
from quadlake.operators.joins import interval_contains


def daily_first(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """First snapshot per key and day."""
    day = F.col(ts).cast("date")
    return (df.groupBy(key, day.alias("_day"))
            .agg(F.min_by(F.struct(*df.columns), F.struct(ts, tie)).alias("_r")).select("_r.*"))


def latest_and_history(batch: DataFrame, key: str, ts: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(latest row per key, history without repeated (key, timestamp))."""
    history = (batch.groupBy(key, ts)
               .agg(F.min_by(F.struct(*batch.columns), tie).alias("_r")).select("_r.*"))
    current = (batch.groupBy(key)
               .agg(F.max_by(F.struct(*batch.columns), F.struct(ts, tie)).alias("_r")).select("_r.*"))
    return current, history


def active_terms(terms: DataFrame, opens: str, closes: str, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return terms.where((F.col(opens) <= now) & (now <= F.col(closes)))


def week_of_term(dates: DataFrame, terms: DataFrame, date: str) -> DataFrame:
    """Weeks, terms and display text of each date.

    `terms`: year, quarter, instruction_start/end, finals_start/end. A date lies in
    at most a handful of concurrent terms, so its list is short. Dates in no term
    get week -1 and "N/A"; combinations the calendar never has get null.
    """
    days = dates.select(date).distinct()
    cols = ["year", "quarter", "instruction_start"]
    teaching = (interval_contains(days, terms.select(*cols, "instruction_end"),
                                  date, "instruction_start", "instruction_end")
                .select(date, *cols, F.lit(0).alias("finals")))
    finals = (interval_contains(days, terms.select(*cols, "finals_start", "finals_end"),
                                date, "finals_start", "finals_end")
              .select(date, *cols, F.lit(1).alias("finals")))
    offset = F.when(F.col("quarter") == "Fall", 4).otherwise(0)
    week = F.floor((F.datediff(F.col(date), F.col("instruction_start")) - offset) / 7) + 1
    hit = F.struct(
        "finals", F.col("instruction_start").alias("start"), "quarter",
        F.when(F.col("finals") == 1, F.lit(-1)).otherwise(week).cast("int").alias("week"),
        term_name("year", "quarter", "week").alias("name"))
    per_day = (teaching.unionByName(finals).groupBy(date)
               .agg(F.array_sort(F.collect_list(hit)).alias("h")))
    joined = dates.join(per_day, date, "left").withColumn(
        "h", F.coalesce("h", F.array().cast(per_day.schema["h"].dataType)))
    n = F.size("h")
    n_finals = F.size(F.filter("h", lambda x: x["finals"] == 1))
    first, second = F.get("h", F.lit(0)), F.get("h", F.lit(1))

    def week_text(x: Column) -> Column:
        return F.concat(F.lit("Week "), x["week"].cast("string"), F.lit(" • "), x["name"])

    luck = F.lit(". Good luck! 🤞")
    display = (
        F.when(n == 0, F.lit("Enjoy your break! 😎"))
        .when((n == 1) & (n_finals == 0), week_text(first))
        .when((n == 1) & (n_finals == 1), F.concat(
            F.when(first["quarter"] == "Summer2", "Finals").otherwise("Finals Week"),
            F.lit(" • "), first["name"], luck))
        .when((n == 2) & (n_finals == 0) & (first["week"] == second["week"]),
              F.concat(week_text(first), F.lit(" | "), second["name"]))
        .when((n == 2) & (n_finals == 0), F.concat_ws(" | ", week_text(first), week_text(second)))
        .when((n == 2) & (n_finals == 1), F.concat(
            F.lit("Finals • "), second["name"], luck, F.lit(" | "), week_text(first))))
    known = display.isNotNull()
    return joined.select(
        *dates.columns,
        F.when(n == 0, F.array(F.lit(-1))).when(known, F.transform("h", lambda x: x["week"])).alias("weeks"),
        F.when(n == 0, F.array(F.lit("N/A"))).when(known, F.transform("h", lambda x: x["name"])).alias("quarters"),
        display.alias("display"))


def hours_status(df: DataFrame, ts: str, place: str, tz: str,
                 open_hours: Mapping[str, Sequence[tuple[int, int, int]]]) -> DataFrame:
    """Add the local hour, the status of the place and whether to poll it.

    `open_hours`: place -> (day 0 = Sunday, first hour, end hour) entries, in which
    hours past midnight belong to the next day. Unknown places are skipped, closed
    ones are polled only in the first quarter of an hour.
    """
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    day, hour = F.dayofweek(local) - 1, F.hour(local)

    def is_open(entries) -> Column:
        out = F.lit(False)
        for d, lo, hi in entries:
            out = out | ((day == d) & (hour >= lo) & (hour < hi))
        return out

    status = F.lit("skip")
    for name, entries in open_hours.items():
        status = F.when(F.col(place) == name, F.when(is_open(entries), "active").otherwise("idle")).otherwise(status)
    return (df.withColumn("local_day", day).withColumn("local_hour", hour).withColumn("status", status)
            .withColumn("poll", (F.col("status") == "active")
                        | ((F.col("status") == "idle") & (F.minute(F.col(ts)) < 15))))

"""Joins of the offering, grade, history and program queries.

No join here carries a broadcast hint: Spark broadcasts a side only below
spark.sql.autoBroadcastJoinThreshold and otherwise shuffles it, and AQE splits
hot keys. Filter-only joins are semi-joins, so they never multiply rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.filters import conjuncts, slot_overlap


def hierarchy(levels: Sequence[DataFrame], keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Inner chain of levels; keys[i] = (column of level i, column of level i + 1)."""
    out = levels[0]
    for child, (parent_col, child_col) in zip(levels[1:], keys, strict=True):
        out = out.join(child, out[parent_col] == child[child_col], "inner")
    return out


def filter_via_bridge(entity: DataFrame, bridge: DataFrame, condition: Column, key: str,
                      bridge_key: str | None = None) -> DataFrame:
    """Entities with at least one bridge row that meets the whole condition."""
    wanted = (bridge.where(condition)
              .select(F.col(bridge_key or key).alias(key)).distinct())
    return entity.join(wanted, key, "left_semi")


def expand_related(matches: DataFrame, children: DataFrame, parent_key: str,
                   cap: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """All children of every parent that has a match; `cap` is the caller's page of parents."""
    parents = matches.select(parent_key).distinct()
    if cap is not None:
        parents = parents.orderBy(*(order or [parent_key])).limit(cap)
    return children.join(parents, parent_key, "left_semi")


def grades_base(course: DataFrame, section: DataFrame, grade: DataFrame, bridge: DataFrame,
                course_key: str, section_keys: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Course, section and grade inner; instructors left, one row per instructor."""
    base = (section.join(grade, list(section_keys), "inner")
            .join(course, course_key, "inner")
            .join(bridge, list(section_keys), "left"))
    return base if condition is None else base.where(condition)


def history_base(section: DataFrame, located: DataFrame, snapshots: DataFrame, key: str,
                 condition: Column | None = None) -> DataFrame:
    """Snapshots of the sections that match and have a located meeting."""
    wanted = section if condition is None else section.where(condition)
    wanted = wanted.join(located.select(key).distinct(), key, "left_semi")
    return snapshots.join(wanted, key, "inner")


def neighbours_both_ways(edges: DataFrame, nodes: DataFrame, key: str, source: str,
                         target: str, shown: Sequence[str]) -> DataFrame:
    """Long form (node, direction, neighbour columns) of a prerequisite graph.

    `source` depends on `target`: direction 'prerequisite' lists what a node needs,
    'dependent' what needs it.
    """
    pairs = edges.select(source, target).distinct()
    both = pairs.select(F.explode(F.array(
        F.struct(F.col(source).alias(key), F.lit("prerequisite").alias("direction"),
                 F.col(target).alias("neighbour")),
        F.struct(F.col(target).alias(key), F.lit("dependent").alias("direction"),
                 F.col(source).alias("neighbour")),
    )).alias("p")).select("p.*")
    preview = nodes.select(F.col(key).alias("neighbour"), *shown)
    return (both.join(nodes.select(key), key, "left_semi")
            .join(preview, "neighbour", "inner"))


def join_null_safe(a: DataFrame, b: DataFrame, eq_keys: Sequence[str],
                   null_safe_keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null on the nullable keys; keys kept from `a`."""
    condition = conjuncts(
        *[a[k] == b[k] for k in eq_keys], *[a[k].eqNullSafe(b[k]) for k in null_safe_keys])
    joined = a.join(b, condition, how)
    for k in (*eq_keys, *null_safe_keys):
        joined = joined.drop(b[k])
    return joined


def unmatched(left: DataFrame, links: DataFrame, key: str, link_value: str,
              exclude: Sequence[str] = ("STAFF",)) -> DataFrame:
    """Rows without a link, or linked only to null; placeholder names are left out."""
    linked = links.where(F.col(link_value).isNotNull()).select(key).distinct()
    return left.where(~F.col(key).isin(list(exclude))).join(linked, key, "left_anti")


def semi_by_subquery(df: DataFrame, col: str, sub: DataFrame, sub_col: str,
                     exclude_suffix: str = "*") -> DataFrame:
    """Rows whose value is listed in the subquery, ignoring listed values marked with a suffix."""
    listed = sub.where(~F.col(sub_col).endswith(exclude_suffix)).select(F.col(sub_col).alias(col))
    return df.join(listed.distinct(), col, "left_semi")


def year_distance(year: Column, target: int) -> Column:
    """Distance to the wanted year; a tie between both directions goes to the later year."""
    gap = year.cast("int") - F.lit(target)
    return F.when(gap >= 0, gap.cast("double")).otherwise(-gap + F.lit(0.5))


def nearest_year(df: DataFrame, entity_keys: Sequence[str], year: str, target: str,
                 is_global: bool = False) -> DataFrame:
    """Rows of the catalogue year closest to the wanted one, per entity or overall.

    The year is chosen by an aggregate and joined back, so an entity with very many
    rows is never sorted in one task.
    """
    score = year_distance(F.substring(F.col(year), 1, 4), int(target[:4]))
    if is_global:
        best = df.agg(F.min_by(F.col(year), score)).scalar()
        return df.where(F.col(year) == best)
    best = df.groupBy(*entity_keys).agg(F.min_by(F.col(year), score).alias(year))
    return df.join(best, [*entity_keys, year], "left_semi")


def latest_only(df: DataFrame, col: str) -> DataFrame:
    """Rows of the overall latest value."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def interval_contains(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str,
                      how: str = "inner") -> DataFrame:
    """Join each date to the date ranges that contain it.

    Ranges are unrolled to their days, which turns the range test into an equi-join:
    no candidate pair is formed that is not a result. Ranges are terms, schedules and
    the like, so a range unrolls to days in the tens or hundreds.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    days = F.sequence(F.col(lo), F.col(hi), F.expr("INTERVAL 1 DAY"))
    unrolled = intervals.where(F.col(lo) <= F.col(hi)).withColumn(point, F.explode(days))
    return points.join(unrolled, point, how)


def interval_or_default(days: DataFrame, schedules: DataFrame, day: str, schedule: str,
                        lo: str, hi: str, pos: str, is_default: Column) -> DataFrame:
    """Schedule in force on each day: the first special range holding it, else the standard one."""
    special = schedules.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    distinct_days = days.select(day).distinct()
    first = (interval_contains(distinct_days, special, day, lo, hi)
             .groupBy(day).agg(F.min_by(schedule, pos).alias("_special")))
    standard = schedules.where(is_default).agg(F.min_by(F.col(schedule), F.col(pos))).scalar()
    return (days.join(first, day, "left")
            .withColumn("active", F.coalesce(F.col("_special"), standard)).drop("_special"))


def expand_calendar(periods: DataFrame, start: str, end: str, hours: str) -> DataFrame:
    """One row per open day of each period; `hours` is a seven-entry array from Sunday."""
    days = F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 DAY"))
    return (periods.where(F.col(start) <= F.col(end)).withColumn("date", F.explode(days))
            .withColumn("day_hours", F.element_at(F.col(hours), F.dayofweek("date")))
            .where(F.col("day_hours").isNotNull()))


def keep_valid(facts: DataFrame, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return facts.join(valid.select(*keys).distinct(), list(keys), "left_semi")


def lookup_tagged(codes: DataFrame, catalogue: DataFrame, code: str, row_keys: Sequence[str],
                  pos: str, course_key: str) -> DataFrame:
    """Each raw code resolved to a course id, or kept as unknown, in row order.

    `catalogue` holds one row per `code`. Lists are per source row and as long as it.
    """
    known = catalogue.select(F.col(code), F.col(course_key).alias("_id"))
    item = F.struct(
        F.col(pos),
        F.when(F.col("_id").isNotNull(), "courseId").otherwise("unknown").alias("type"),
        F.coalesce(F.col("_id").cast("string"), F.col(code)).alias("value"))
    return (codes.join(known, code, "left").groupBy(*row_keys)
            .agg(F.array_sort(F.collect_list(item)).alias("entries")))


def latest_dim(dim: DataFrame, key: str, by: str) -> DataFrame:
    """Newest dimension row per key."""
    rest = [c for c in dim.columns if c != key]
    return (dim.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r"))
            .select(key, "_r.*"))


def attach_section_key(records: DataFrame, section: DataFrame, keys: Sequence[str],
                       term: str, section_key: str, umbrella: Mapping[str, Sequence[str]]) -> DataFrame:
    """Find the section of each external record; an umbrella term stands for its sessions.

    Among several sections the smallest key wins; records without one are left out, equal
    records all stay. Sections take the names they can be asked by, so records move once.
    """
    named: dict[str, list[str]] = {}
    for whole, members in umbrella.items():
        for member in members:
            named.setdefault(member, []).append(whole)
    also = F.lit(None).cast("array<string>")
    for member, wholes in named.items():
        also = F.when(F.col(term) == member, F.array(*[F.lit(w) for w in wholes])).otherwise(also)
    own = F.when(F.col(term).isin(list(umbrella)), F.array().cast("array<string>")).otherwise(F.array(F.col(term)))
    names = F.array_distinct(F.concat(own, F.coalesce(also, F.array().cast("array<string>"))))
    by_term = [k for k in keys if k != term]
    firsts = (section.withColumn("_asked", F.explode(names)).groupBy(*by_term, F.col("_asked").alias(term))
              .agg(F.min(section_key).alias(section_key)))
    return records.join(firsts, list(keys), "inner").select(*records.columns, section_key)


def attach_offering(cards: DataFrame, offerings: DataFrame, year: str, term: str, course: str,
                    offering_key: str) -> DataFrame:
    """Offering of each card by (year, term, department, number); the course text is split at
    its last blank. The first offering wins, cards without one are left out.

    offerings: year, term, department, course_number, `offering_key`.
    """
    number = F.substring_index(F.trim(course), " ", -1)
    split = cards.withColumns({
        "department": F.trim(F.left(F.trim(course), F.length(F.trim(course)) - F.length(number))),
        "course_number": number})
    keys = [year, term, "department", "course_number"]
    firsts = offerings.groupBy(*keys).agg(F.min(offering_key).alias(offering_key))
    return split.join(firsts, keys, "inner")


def require_one_to_one(parent: DataFrame, key: str, children: Mapping[str, DataFrame]
                       ) -> tuple[DataFrame, DataFrame]:
    """Parents with all their one-to-one children, and the parents that miss one."""
    joined = parent
    flags = []
    for name, child in children.items():
        flag = f"_has_{name}"
        joined = joined.join(child.withColumn(flag, F.lit(True)), key, "left")
        flags.append((name, flag))
    missing = F.array_compact(F.array(*[
        F.when(F.col(flag).isNull(), F.lit(name)) for name, flag in flags]))
    marked = joined.withColumn("missing", missing).drop(*[f for _, f in flags])
    whole = marked.where(F.size("missing") == 0).drop("missing")
    violations = marked.where(F.size("missing") > 0).select(key, "missing")
    return whole, violations


def hydrate(ids: DataFrame, records: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Full records of a page of ranked ids."""
    return ids.join(records, key, how)


def slots_matching(rooms: DataFrame, slots: DataFrame, key: str, start: str, end: str,
                   dates=None, ranges=None, room_filter: Column | None = None) -> DataFrame:
    """Rooms with their matching slots; a slot filter leaves out rooms without a hit."""
    chosen = rooms if room_filter is None else rooms.where(room_filter)
    how = "inner" if dates or ranges else "left"
    return chosen.join(slots.where(slot_overlap(start, end, dates, ranges)), key, how)

"""Degree programs: code mapping, parents, pattern expansion, table loads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed
from quadlake.functions.project import label
from quadlake.operators.upsert import last_wins
from quadlake.plans.rules import classify_constraints, invert_exclusion


def map_case_insensitive(left: DataFrame, mid: DataFrame, right: DataFrame, left_col: str,
                         mid_col: str, right_key: str, aliases: Mapping[str, str],
                         alias_on: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two-hop lookup ignoring case, with overrides; also the rows that found nothing."""
    wanted = F.col(left_col)
    if aliases:
        wanted = F.coalesce(label(alias_on or left_col, aliases), wanted)
    named = left.withColumn(left_col, wanted).withColumn("_k", F.lower(left_col))
    known = mid.withColumn("_k", F.lower(mid_col))
    mapped = named.join(known, "_k", "inner").join(right, right_key, "inner").drop("_k")
    missing = named.join(known.select("_k").distinct(), "_k", "left_anti").drop("_k")
    return mapped, missing


def parent_by_suffix(children: DataFrame, parents: DataFrame, child_code: str, parent_code: str,
                     pos: str, overrides: Mapping[str, str]) -> DataFrame:
    """Parent of a specialization: its code without the last capital letter.

    Overrides name the parent outright. Among several parents with the code the
    first in parse order wins; children without a parent keep null.
    """
    stem = F.nullif(F.regexp_extract(F.col(child_code), "^(.+)[A-Z]$", 1), F.lit(""))
    wanted = F.coalesce(label(child_code, overrides), stem) if overrides else stem
    rest = [c for c in parents.columns if c != parent_code]
    first = (parents.groupBy(F.col(parent_code).alias("_parent"))
             .agg(F.min_by(F.struct(*rest), pos).alias("_r"))
             .select("_parent", *[F.col(f"_r.{c}").alias(f"parent_{c}") for c in rest]))
    return children.withColumn("_parent", wanted).join(first, "_parent", "left").drop("_parent")


def expand_patterns(patterns: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Courses named by "DEPT NUMBER" patterns, one row per (keys, course).

    Kinds: `@` any number, `1@` / `1@@` numbers that go on from the prefix by at
    least one / two word characters, `100-199` a range, otherwise one course.
    "ELECTIVE @" names nothing. Every kind is an equi-join: whole departments on the
    department, prefixes on (department, prefix), ranges on (department, hundred).
    """
    dept, number = F.substring_index("pattern", " ", 1), F.substring_index("pattern", " ", -1)
    parsed = (patterns.where(~F.col("pattern").rlike(r"ELECTIVE @+"))
              .select(*keys, "pattern", dept.alias("_dept"), number.alias("_num")).distinct())
    courses = catalogue.select("course_id", F.col("shortened_dept").alias("_dept"),
                               "course_number", "course_numeric")
    out = [*keys, "course_id"]

    whole = parsed.where(F.col("_num") == "@").join(courses, "_dept").select(*out)

    is_prefix = F.col("_num").rlike(r"\w@")
    stem = F.regexp_extract("_num", r"^([^@]*)@", 1)
    more = F.when(F.col("_num").contains("@@"), 2).otherwise(1)
    prefixed = parsed.where(is_prefix).select(*keys, "_dept", stem.alias("_stem"), more.alias("_more"))
    # Course numbers are a few characters long, so each has a few proper prefixes.
    cuts = F.sequence(F.lit(1), F.length("course_number") - 1)
    stems = (courses.where(F.length("course_number") > 1)
             .withColumn("_cut", F.explode(cuts))
             .withColumn("_stem", F.expr("substring(course_number, 1, _cut)"))
             .withColumn("_left", F.regexp_extract(
                 F.expr("substring(course_number, _cut + 1)"), r"^\w*", 0)))
    by_prefix = (prefixed.join(stems, ["_dept", "_stem"])
                 .where(F.length("_left") >= F.col("_more")).select(*out))

    is_range = ~is_prefix & (F.col("_num") != "@") & F.col("_num").rlike(r"-\w+")

    def bound(i: int) -> Column:
        return F.regexp_replace(F.split("_num", "-")[i], "[A-Z]", "").try_cast("int")

    ranges = (parsed.where(is_range).select(*keys, "_dept", bound(0).alias("_lo"), bound(1).alias("_hi"))
              .where("_lo <= _hi")
              .withColumn("_hundred", F.explode(F.expr(
                  "sequence(cast(floor(_lo / 100) as int), cast(floor(_hi / 100) as int))"))))
    hundreds = courses.withColumn("_hundred", F.floor(F.col("course_numeric") / 100).cast("int"))
    by_range = (ranges.join(hundreds, ["_dept", "_hundred"])
                .where(F.col("course_numeric").between(F.col("_lo"), F.col("_hi"))).select(*out))

    plain = parsed.where(~is_prefix & ~is_range & (F.col("_num") != "@"))
    by_id = (plain.withColumn("course_id", F.concat("_dept", "_num"))
             .join(courses.select("course_id").distinct(), "course_id", "left_semi").select(*out))

    return whole.unionByName(by_prefix).unionByName(by_range).unionByName(by_id).distinct()


def requirement_courses(includes: DataFrame, excludes: DataFrame, catalogue: DataFrame,
                        keys: Sequence[str], catalog_year: str) -> DataFrame:
    """Courses that fulfil each requirement, with the constraints that remain on them.

    includes, excludes: keys, pattern, clauses (see `rules.classify_constraints`).
    catalogue: course_id, shortened_dept, course_number, course_numeric, min_units,
    max_units. An included course goes if it never meets its clauses, an excluded one if
    the exclusion has no clauses or leaves nothing allowed. Clauses met only sometimes
    stay with the course: `any_of` holds the included lists, `all_of` the inverted ones.
    """
    clause_type = includes.schema["clauses"].dataType
    nothing = F.array().cast(clause_type)
    wanted = includes.select(*keys, "pattern", "clauses", F.lit("in").alias("role"))
    unwanted = excludes.select(
        *keys, "pattern", F.coalesce(invert_exclusion("clauses"), nothing).alias("clauses"),
        F.when(F.size("clauses") == 0, "out").otherwise("limit").alias("role"))
    units = catalogue.select("course_id", "min_units", "max_units").distinct()
    hits = expand_patterns(wanted.unionByName(unwanted), catalogue, [*keys, "clauses", "role"])
    rated = classify_constraints(hits.join(units, "course_id"), "clauses", "min_units", "max_units", catalog_year)
    role, match = F.col("role"), F.col("match")

    def sometimes(of: str, name: str) -> Column:
        # A course has as many lists as a requirement has patterns for it: a handful.
        return F.array_sort(F.collect_set(F.when((role == of) & (match == "sometimes"), F.col("clauses")))).alias(name)

    per_course = rated.groupBy(*keys, "course_id").agg(
        F.bool_or((role == "in") & (match != "never")).alias("_in"),
        F.bool_or((role == "out") | ((role == "limit") & (match == "never"))).alias("_out"),
        sometimes("in", "any_of"), sometimes("limit", "all_of"))
    return per_course.where("_in AND NOT _out").drop("_in", "_out")


def load_programs(records: DataFrame, catalog_year: str, minors: DataFrame | None = None,
                  schools: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fan one (major, specialization) record out to its tables; of records with equal keys the last by `pos` stays.

    Columns of `records`: pos, degree, degree_name, major_code, major_name, requirements, specialization_required,
    college_name, college_requirements, and spec_code (null for the major itself), spec_name, spec_requirements. `minors`: pos, code,
    name, requirements. `schools`: pos, kind (UC, GE, CHC4, CHC2), requirements; kinds without requirements are left out.
    Ids are degree and code: of the major, or of the specialization. Equal requirements are one, by their hash.
    """
    division = F.when(F.col("degree").startswith("B"), "Undergraduate").otherwise("Graduate")
    base = records.withColumns({"major_id": F.concat_ws("-", "degree", "major_code"),
                                "specialization_id": F.when(F.col("spec_code").isNotNull(), F.concat_ws("-", "degree", "spec_code")),
                                "requirement_id": F.xxhash64("requirements")})
    majors, specs = base.where(F.col("spec_code").isNull()), base.where(F.col("spec_code").isNotNull())
    year = F.lit(catalog_year).alias("catalog_year")

    def last(rows: DataFrame, keys: list[str], **columns) -> DataFrame:
        chosen = [F.lit(catalog_year).alias(k) if k == "catalog_year" else F.col(columns[k]).alias(k) if k in columns else F.col(k) for k in keys]
        rest = [(c if not isinstance(c, str) else F.col(c)).alias(n) for n, c in columns.items() if n not in keys]
        return last_wins(rows.select(*chosen, *rest, "pos"), keys, ["pos"]).drop("pos")

    tables = {
        "degree": last(base, ["id"], id="degree", name="degree_name", division=division),
        "major": last(majors, ["id"], id="major_id", degree_id="degree", code="major_code", name="major_name"),
        "major_requirement": base.select(F.col("requirement_id").alias("id"), "requirements").distinct(),
        "major_year": last(majors, ["major_id", "catalog_year"], specialization_required="specialization_required",
                           college_requirements_title="college_name", college_requirements="college_requirements"),
        "major_specialization": last_wins(base.select("major_id", "specialization_id", year, "requirement_id", "pos"),
                                          ["major_id", "specialization_id", "catalog_year"], ["pos"]).drop("pos"),
        "specialization": last(specs, ["id"], id="specialization_id", major_id="major_id", name="spec_name"),
        "specialization_requirement": last(specs, ["specialization_id", "catalog_year"], requirements="spec_requirements"),
    }
    if minors is not None:
        tables["minor"] = last(minors, ["id"], id="code", name="name")
        tables["minor_requirement"] = last(minors, ["minor_id", "catalog_year"], minor_id="code", requirements="requirements")
    if schools is not None:
        tables["school_requirement"] = last(schools.where("requirements IS NOT NULL"), ["kind", "catalog_year"], requirements="requirements")
    return tables


def load_credit_rules(rules: DataFrame) -> dict[str, DataFrame]:
    """Exam credit rules to exam, reward and score tables.

    Columns of `rules`: exam, catalogue_name, rewards array of struct(scores,
    units, elective_units, ge map, courses). A score granted twice goes to the
    later reward; categories a reward does not mention grant nothing.
    """
    exploded = rules.select("exam", "catalogue_name", F.posexplode("rewards").alias("pos", "r"))
    reward_id = F.sha2(F.concat_ws("|", "exam", F.col("pos").cast("string")), 256)
    rewards = exploded.select(
        reward_id.alias("reward_id"), "exam", "pos", F.col("r.units").alias("units"),
        F.col("r.elective_units").alias("elective_units"),
        *[F.coalesce(F.try_element_at("r.ge", F.lit(code)), F.lit(0)).alias("ge_" + code[3:].lower())
          for code in fixed.CATEGORY_CODES],
        F.col("r.courses").alias("courses"))
    scores = last_wins(
        exploded.select("exam", F.explode("r.scores").alias("score"), "pos", reward_id.alias("reward_id")),
        ["exam", "score"], ["pos"]).drop("pos")
    exams = rules.select("exam", "catalogue_name").distinct()
    return {"exam": exams, "reward": rewards, "score": scores}

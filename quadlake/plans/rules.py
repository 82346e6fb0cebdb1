"""Degree rules: requirement trees, content ids, course constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed
from quadlake.functions.project import content_id
from quadlake.sources import sinks

# Words that speak of a specialization, and one advice text that does not.
SPECIALIZATION_WORDS = "(?i)specialization|concentration|emphasis|area|track|major"
NOT_REQUIRED_ADVICE = (
    "16 units of approved technical electives or",
    "contact advisor to select a specialization.",
)
SELECT_ONE = "Select 1 of the following"


def requirement_id(kind, salt) -> Column:
    payload = F.to_json(F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("requirementType"), salt.alias("contentsSalt")))
    return content_id(payload)


def content_ids(nodes: DataFrame, kind: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with their content id, ids that stand for different contents)."""
    marked = nodes.withColumn("requirement_id", requirement_id(F.col(kind), F.col(salt)))
    digest = F.sha2(F.concat_ws("|", kind, salt), 256)
    collisions = (marked.groupBy("requirement_id")
                  .agg(F.min(digest).alias("lowest"), F.max(digest).alias("highest"))
                  .where("lowest <> highest").select("requirement_id"))
    return marked, collisions


def plain_label(text: Column) -> Column:
    """Labels change once a requirement is met; keep the unmet wording."""
    return F.replace(F.replace(text, F.lit(" Satisfied"), F.lit(" Required")),
                     F.lit(" satisfied"), F.lit(" required"))


def first_block(audits: DataFrame, key: Sequence[str], blocks: str, kind: str, value: Column) -> DataFrame:
    """First block of each audit with the wanted type and value; `blocks` is a VARIANT array."""
    listed = audits.select(*key, value.alias("_value"), F.posexplode(
        F.expr(f"try_variant_get({blocks}, '$', 'array<variant>')")).alias("_pos", "_b"))
    wanted = ((F.try_variant_get("_b", "$.requirementType", "string") == kind)
              & (F.try_variant_get("_b", "$.requirementValue", "string") == F.col("_value")))
    found = listed.where(wanted).withColumn("_json", F.to_json("_b"))
    return (found.groupBy(*key).agg(F.min_by("_json", "_pos").alias("_json"))
            .select(*key, F.parse_json("_json").alias("block")))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _rules(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _kind(v: Column) -> Column:
    return _get(v, "$.ruleType")


def _branches(v: Column) -> Column:
    """Rules of both parts of a condition."""
    return F.concat(_rules(v, "$.requirement.ifPart.ruleArray"), _rules(v, "$.requirement.elsePart.ruleArray"))


def _course_names(v: Column) -> Column:
    return F.transform(_rules(v, "$.requirement.courseArray"), lambda c: F.concat(
        _get(c, "$.discipline"), F.lit(" "), _get(c, "$.number"),
        F.coalesce(F.concat(F.lit("-"), _get(c, "$.numberEnd")), F.lit(""))))


def _walked(audits: DataFrame, key: str, rules: str) -> list[DataFrame]:
    """Rules by their depth in the documents: key, path, owner, depth of the owner, owners, and what is read off each.

    Each round opens the rules of the last one and writes the rules they hold, so every rule is read once and the walk
    ends where no rule holds another. Paths order siblings as in the source. A condition right inside a
    condition is none of its own: what it holds belongs to the outer one.
    """
    def place(at: str) -> Column:
        return F.lpad(F.col(at).cast("string"), 4, "0")

    open_ = (audits.select(key, F.posexplode(_rules(F.col(rules), "$")).alias("i", "v"))
             .select(key, place("i").alias("path"), F.lit("").alias("owner"), F.lit(-1).alias("held_at"),
                     F.array().cast("array<string>").alias("owners"), F.lit(False).alias("within"), "v"))
    levels, depth = [], 0
    while True:
        read = open_.withColumn("rule_type", _kind(F.col("v"))).withColumn("through", F.col("within") & (F.col("rule_type") == "IfStmt"))
        held = (F.when(F.col("rule_type") == "IfStmt", _branches(F.col("v")))
                .when(F.col("rule_type").isin("Group", "Subset"), _rules(F.col("v"), "$.ruleArray")))
        v = F.col("v")
        level = sinks.keep(read.select(
            key, "path", "owner", "held_at", "owners", "rule_type", "through", plain_label(_get(v, "$.label")).alias("text"),
            _get(v, "$.requirement.classesBegin").try_cast("int").alias("classes"),
            _get(v, "$.requirement.creditsBegin").try_cast("int").alias("credits"),
            _get(v, "$.requirement.numberOfGroups").try_cast("int").alias("groups"), _course_names(v).alias("listed"), held.alias("held")), "rules")
        levels.append(level.where("NOT coalesce(through, false)").drop("through", "held"))
        more = level.where(F.size("held") > 0)
        if more.isEmpty():
            return levels
        through = F.coalesce("through", F.lit(False))
        open_ = (more.select(key, F.col("path").alias("above"), F.when(through, F.col("owner")).otherwise(F.col("path")).alias("owner"),
                             F.when(through, F.col("held_at")).otherwise(F.lit(depth)).alias("held_at"),
                             F.when(through, F.col("owners")).otherwise(F.concat("owners", F.array("path"))).alias("owners"),
                             (F.col("rule_type") == "IfStmt").alias("within"), F.posexplode("held").alias("i", "v"))
                 .withColumn("path", F.concat_ws(".", "above", place("i"))).drop("above", "i"))
        depth += 1


def _resolved(level: DataFrame, key: str, below: DataFrame | None) -> DataFrame:
    """Requirements of the rules of one depth, given the resolved rules they own."""
    ids, counted = F.array().cast("array<string>"), level.withColumns({"n_rules": F.lit(0), "blocked": F.lit(False)})
    if below is not None:
        listed = F.array_sort(F.collect_list(F.when(F.col("requirement_id").isNotNull(), F.struct("path", "requirement_id"))))
        inner = below.groupBy(F.col(key).alias("_key"), F.col("owner").alias("_owner")).agg(
            F.count("*").cast("int").alias("n_rules"), F.bool_or(F.coalesce(F.col("rule_type") == "Block", F.lit(False))).alias("blocked"),
            F.transform(listed, lambda x: x["requirement_id"]).alias("ids"))
        counted = (level.join(inner, (F.col(key) == F.col("_key")) & (F.col("path") == F.col("_owner")), "left").drop("_key", "_owner")
                   .na.fill({"n_rules": 0, "blocked": False}))
        ids = F.coalesce("ids", ids)
    counted = counted.withColumn("ids", ids)
    rule = F.col("rule_type")
    kind = (F.when((rule == "Course") & F.col("classes").isNotNull(), "Course")
            .when((rule == "Course") & F.col("credits").isNotNull(), "Unit")
            .when(rule.isin("Group", "Subset"), "Group")
            .when((rule == "IfStmt") & ~F.col("blocked") & (F.col("n_rules") > 1), "Group")
            .when(rule.isin("Complete", "Incomplete"), "Marker"))
    needed = (F.when(F.col("kind") == "Course", F.col("classes")).when(F.col("kind") == "Unit", F.col("credits"))
              .when(rule == "Group", F.col("groups")).when(rule == "Subset", F.size("ids"))
              .when(F.col("kind").isNotNull() & (rule == "IfStmt"), 1))
    salt = (F.when(F.col("kind").isin("Course", "Unit"), F.array_join("listed", "_"))
            .when(F.col("kind") == "Marker", F.col("text")).otherwise(F.array_join("ids", "_")))
    # A condition around a single rule stands for that rule.
    passed = F.when((rule == "IfStmt") & ~F.col("blocked") & (F.col("n_rules") == 1), F.get("ids", F.lit(0)))
    return counted.withColumn("kind", kind).withColumns({
        "label": F.when(F.col("kind").isNotNull(), F.when(rule == "IfStmt", SELECT_ONE).otherwise(F.col("text"))),
        "needed": needed, "courses": F.when(F.col("kind").isin("Course", "Unit"), F.col("listed")),
        "requirement_id": F.when(F.col("kind").isNotNull(), requirement_id(F.col("kind"), salt)).otherwise(passed)}).select(
        key, "path", "owner", "held_at", "owners", "rule_type", "blocked", "kind", "label", "needed", "courses", "requirement_id")


def requirement_nodes(audits: DataFrame, key: str, rules: str) -> DataFrame:
    """Requirements of the audits, rules of any depth included.

    Columns: key, path, parent_path, kind, label, needed, courses, requirement_id.
    Blocks and non-course rules vanish, conditions become "select one" groups or their
    only rule, a condition around a block vanishes whole. Ids hash the contents from
    the leaves upwards. The documents are walked once, from the root down; then each depth is resolved
    from what the deeper ones gave it, so the work is linear in the rules however deep they lie. Every round is
    written to the work folder: this runs jobs, as many as the documents are deep.
    """
    levels = _walked(audits, key, rules)
    resolved = [sinks.keep(_resolved(levels[-1], key, None), "resolved")]
    for depth in reversed(range(len(levels) - 1)):
        below = resolved[0].where(F.col("held_at") == depth)
        for deeper in resolved[1:]:
            below = below.unionByName(deeper.where(F.col("held_at") == depth))
        resolved.append(sinks.keep(_resolved(levels[depth], key, below), "resolved"))
    nodes = resolved[0]
    for more in resolved[1:]:
        nodes = nodes.unionByName(more)
    dropped = (nodes.where((F.col("rule_type") == "IfStmt") & F.col("blocked")).groupBy(F.col(key).alias("_key"))
               .agg(F.collect_list("path").alias("_dropped")))
    kept = (nodes.where("kind IS NOT NULL").join(dropped, F.col(key) == F.col("_key"), "left")
            .where(~F.coalesce(F.arrays_overlap("owners", "_dropped"), F.lit(False))))
    return kept.select(key, "path", F.col("owner").alias("parent_path"), "kind", "label", "needed", "courses", "requirement_id")


def needs_specialization(rules: str) -> Column:
    """Whether a rule that was not met advises to pick a specialization; `rules` is an
    array<struct(if_else_part, advice array<string>)>."""
    exempt = F.array(*[F.lit(x) for x in NOT_REQUIRED_ADVICE])

    def is_exempt(advice: Column) -> Column:
        marked = F.transform(advice, lambda x, i: x.eqNullSafe(F.get(exempt, i)))
        return F.forall(marked, lambda ok: ok)

    return F.exists(F.col(rules), lambda r: (
        (r["if_else_part"] == "ElsePart")
        & F.exists(r["advice"], lambda x: x.rlike(SPECIALIZATION_WORDS)) & ~is_exempt(r["advice"])))


NEVER, SOMETIMES, ALWAYS = 0, 1, 2
RESULTS = ("never", "sometimes", "always")


def _compare(value: Column, operator: Column, target: Column) -> Column:
    return (F.when(operator == "<", value < target).when(operator == "<=", value <= target)
            .when(operator == "=", value == target).when(operator == ">", value > target)
            .when(operator == ">=", value >= target).when(operator == "<>", value != target))


def _of_values(values: Column, test) -> Column:
    return (F.when(F.forall(values, test), ALWAYS).when(F.exists(values, test), SOMETIMES).otherwise(NEVER))


def classify_constraints(courses: DataFrame, clauses: str, min_units: str, max_units: str,
                         catalog_year: str) -> DataFrame:
    """Add `match`: whether a course always, sometimes or never meets its clauses.

    `clauses`: array<struct(connector, code, operator, values array<string>)>; OR starts
    a new group, the clauses of a group are ANDed. On the scale never < sometimes <
    always an AND is a minimum and an OR a maximum.
    """
    start = int(catalog_year[:4])
    years = [start if term == "Fall" else start + 1 for term in fixed.CALENDAR_TERMS]
    terms = F.array(*[F.lit(y * 10 + fixed.TERM_ORDINAL[t])
                      for y, t in zip(years, fixed.CALENDAR_TERMS, strict=True)])
    units = F.sequence(F.col(min_units).cast("int"), F.col(max_units).cast("int"))
    upper = F.create_map(*[F.lit(x) for t, o in fixed.TERM_ORDINAL.items() for x in (t.upper(), o)])

    def leaf(c: Column) -> Column:
        value = c["values"][0].try_cast("int")
        targets = F.transform(c["values"], lambda raw: (
            F.substring_index(raw, " ", 1).try_cast("int") * 10
            + F.try_element_at(upper, F.substring_index(raw, " ", -1))))
        by_units = _of_values(units, lambda u: _compare(u, c["operator"], value))
        by_terms = _of_values(terms, lambda t: F.exists(targets, lambda x: _compare(t, c["operator"], x)))
        return (F.when(c["code"].isin(*fixed.CREDIT_CODES), by_units)
                .when(c["code"].isin(*fixed.TERM_CODES), by_terms).otherwise(ALWAYS))

    zero = F.struct(F.lit(-1).alias("best"), F.lit(3).alias("group"))

    def step(acc: Column, c: Column) -> Column:
        opens = (c["connector"] == "OR") & (acc["group"] < 3)
        here = leaf(c)
        best = F.when(F.coalesce(opens, F.lit(False)), F.greatest(acc["best"], acc["group"])).otherwise(acc["best"])
        group = F.when(F.coalesce(opens, F.lit(False)), here).otherwise(F.least(acc["group"], here))
        return F.struct(best.alias("best"), group.alias("group"))

    score = F.when(F.size(clauses) > 0, F.aggregate(
        clauses, zero, step, lambda acc: F.greatest(acc["best"], acc["group"]))).otherwise(ALWAYS)
    names = F.array(*[F.lit(r) for r in RESULTS])
    return courses.withColumn("match", F.get(names, score))


def invert_exclusion(clauses: str) -> Column:
    """Clauses of an exclusion turned into what remains allowed.

    Only a single credit clause can be inverted; another single clause leaves no
    constraint, several are not supported and give null.
    """
    inverted = F.create_map(*[F.lit(x) for pair in fixed.INVERTED_OPERATOR.items() for x in pair])
    credit = F.filter(F.col(clauses), lambda c: c["code"].isin(*fixed.CREDIT_CODES))
    turned = F.transform(credit, lambda c: c.withField("operator", F.try_element_at(inverted, c["operator"])))
    return F.when(F.size(clauses) == 1, turned)

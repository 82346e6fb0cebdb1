"""Directory entries and the resolution of short instructor names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed
from quadlake.functions.parsing import decode_entities, title_case

# The row that stands for every student, and the title patterns by rank.
STUDENT_ID = "student"
REDACTED = {"name": "REDACTED REDACTED", "email": "noreply@example.org", "department": "REDACTED", "title": "REDACTED"}
TITLE_TIERS = {"professor": "[Pp]rofessor", "lecturer": "[Ll]ecturer"}


def clean_directory(raw: DataFrame, redacted: Mapping[str, str] = REDACTED) -> DataFrame:
    """Decoded, title-cased directory rows; students become the redacted row.

    Columns: person_id, name, email (base64), department, title, student_level.
    """
    is_student = F.col("student_level").isNotNull() & (F.col("student_level") != "")

    def unless(col: Column, value: str) -> Column:
        return F.when(is_student, F.lit(value)).otherwise(col)

    return raw.select(
        unless(decode_entities("person_id"), STUDENT_ID).alias("person_id"),
        unless(title_case(decode_entities("name")), redacted["name"]).alias("name"),
        unless(F.unbase64("email").cast("string"), redacted["email"]).alias("email"),
        unless(decode_entities("department"), redacted["department"]).alias("department"),
        unless(decode_entities("title"), redacted["title"]).alias("title"))


def resolve_names(names: DataFrame, directory: DataFrame, name: str = "name",
                  tiers: Mapping[str, str] = TITLE_TIERS) -> DataFrame:
    """(name, person_id): the one person a short name can mean, else null.

    "LAST, F.M." matches an entry whose first tokens start with the initials and whose
    later tokens hold the surname: the same word, for long surnames a word that starts
    with it, for several words a run of words that start with them. Several matches are
    narrowed by title, tier by tier. Candidates come from equi-joins on the first
    initial and the surname (or its first word as a prefix), so no cross product forms.
    directory: person_id, full_name, title, is_student.
    """
    short = F.trim(F.regexp_replace(F.lower(name), ", ?", " "))
    last_word = F.substring_index(short, " ", -1)
    no_space = ~short.contains(" ")

    def dots(text: Column) -> Column:
        return F.trim(F.replace(text, F.lit("."), F.lit(" ")))

    surname = dots(F.when(no_space, short).otherwise(F.left(short, F.length(short) - F.length(last_word))))
    initials = F.when(no_space, F.lit("")).otherwise(dots(last_word))
    wanted = names.select(name).distinct().select(
        name, F.split(surname, " ").alias("s"), F.split(initials, " ").alias("i"))
    wanted = wanted.withColumns({
        "_initial": F.left(F.col("i")[0], F.lit(1)), "_word": F.col("s")[0],
        "_exact": (F.size("s") == 1) & (F.length(F.col("s")[0]) < fixed.SURNAME_CUTOFF)})

    tokens = F.transform(F.split(F.lower(decode_entities("full_name")), " "), lambda x: F.trim(x))
    people = directory.select("person_id", "title", "is_student", tokens.alias("t")).withColumn(
        "_first", F.left(F.col("t")[0], F.lit(1)))
    # Each entry under its own first letter and under "no initial given".
    people = people.withColumn("_initial", F.explode(F.array_distinct(F.array(F.col("_first"), F.lit("")))))
    people = people.withColumn("_words", F.array_distinct(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))))
    words = people.withColumn("_word", F.explode("_words")).drop("_words")
    # Prefixes only of the lengths some name asks for; there are as many as letters in a word. An entry has each once, so
    # nothing has to be gathered to tell them apart, and a person of several entries is found under any of them.
    lengths = wanted.where("NOT _exact").agg(F.collect_set(F.length("_word"))).scalar()
    cut = F.transform(F.filter("_words", lambda w: F.length(w) >= F.col("_len")), lambda w: w.substr(F.lit(1), F.col("_len")))
    prefixes = (people.withColumn("_len", F.explode(lengths))
                .withColumn("_word", F.explode(F.array_distinct(cut))).drop("_len", "_words"))

    k = F.size("i")
    starts = F.forall(F.sequence(F.lit(0), F.least(k, F.size("t")) - 1),
                      lambda p: F.startswith(F.get("t", p), F.get("i", p)))
    later = F.slice("t", k + 1, F.greatest(F.size("t") - k, F.lit(0)))
    long_word = F.exists(later, lambda w: F.startswith(w, F.col("s")[0]))
    runs = F.size("t") - (F.size("s") - 1) - k
    run = (runs > 0) & F.exists(
        F.sequence(k, k + F.greatest(runs, F.lit(1)) - 1),
        lambda at: F.forall(F.sequence(F.lit(0), F.size("s") - 1),
                            lambda j: F.startswith(F.get("t", at + j), F.get("s", j))))
    same_word = F.array_contains(later, F.col("s")[0])

    exact = wanted.where("_exact").join(words, ["_initial", "_word"]).where(starts & same_word)
    loose = wanted.where("NOT _exact").join(prefixes, ["_initial", "_word"]).where(
        starts & F.when(F.size("s") == 1, long_word).otherwise(run))
    shown = F.when(F.col("is_student"), STUDENT_ID).otherwise(F.col("person_id")).alias("shown")
    cols = [name, "person_id", "title", shown]
    hits = exact.select(*cols).unionByName(loose.select(*cols)).distinct()

    counts = [F.count(F.lit(1)).alias("_n"), F.min("shown").alias("_who")]
    choice = F.when(F.col("_n") == 1, F.col("_who"))
    for tier, pattern in tiers.items():
        has = F.col("title").rlike(pattern)
        counts += [F.count_if(has).alias(f"_n_{tier}"), F.min(F.when(has, F.col("shown"))).alias(f"_who_{tier}")]
        choice = F.coalesce(choice, F.when(F.col(f"_n_{tier}") == 1, F.col(f"_who_{tier}")))
    picked = hits.groupBy(name).agg(*counts).select(name, choice.alias("person_id"))
    return names.select(name).distinct().join(picked, name, "left")

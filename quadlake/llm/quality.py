"""Quality rules with thresholds from quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm.common import apart, stored, text_or_empty, tidy

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50

#: Measures in thousandths, and how far beyond the quartiles a document may lie at least.
SLACK = {"symbols": 250, "dup_lines": 450, "repeats": 350, "word_length": 1500}
#: Quartile distances beyond the quartiles that are still usual.
REACH = 3
#: A group with fewer documents borrows the merged sketch of its language, or else of all.
MIN_GROUP = 200

_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SCHEMA = pa.schema([(n, pa.int64()) for n in _FIELDS])


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        count: dict = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeated = sum(covered)
    return n, chars, symbols, dup, repeated, len(lines)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` and a struct column _m with the counts of `measure`; null text counts as empty."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [measure(t or "") for t in b.column(text).to_pylist()]
            cells = pa.StructArray.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in range(len(_FIELDS))], fields=list(_SCHEMA))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*names, "_m"])

    return docs.mapInArrow(tidy(run), schema + ", _m struct<" + ", ".join(f"{n}: bigint" for n in _FIELDS) + ">")


def _thousandths(part: str, whole: str) -> Column:
    return F.when(F.col(f"_m.{whole}") > 0, F.expr(f"_m.{part} * 1000 div _m.{whole}")).otherwise(F.lit(0))


def _measures() -> dict[str, Column]:
    return {"symbols": _thousandths("n_symbols", "n_words"), "dup_lines": _thousandths("n_dup_lines", "n_lines"),
            "repeats": _thousandths("n_repeat_words", "n_words"), "word_length": _thousandths("word_chars", "n_words")}


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket: exact below 128, then 7 leading bits (under 1.6% off)."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _group(lang: str, source: str) -> dict[str, Column]:
    return {"_l0": F.col(lang).isNull(), "_l": F.coalesce(F.col(lang).cast("string"), F.lit("")),
            "_s0": F.col(source).isNull(), "_s": F.coalesce(F.col(source).cast("string"), F.lit(""))}


KEY = ["_l0", "_l", "_s0", "_s"]


def sketches(counts: DataFrame) -> DataFrame:
    """(language, source, measure, bucket, n) over rows with KEY columns and _m.

    Counts per bucket are a quantile sketch: sketches merge by adding counts, in any order, so
    tasks combine before the shuffle, a rerun gives the same sketch, and a sketch has at most a
    few hundred buckets however many documents it describes. Documents without words tell nothing.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), bucket(v).alias("bucket"))
                                for name, v in _measures().items()])).alias("c")
    return (counts.where("_m.n_words > 0").select(*KEY, cells)
            .groupBy(*KEY, "c.measure", "c.bucket").agg(F.count("*").alias("n")))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = (merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket")
                                                        .rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("total", F.sum("n").over(group)))
    at = {q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).alias(q)
          for q, k in (("q1", 1), ("q3", 3))}
    return ranked.groupBy(*by, "measure").agg(F.first("total").alias("total"), *at.values())


def thresholds(sketch: DataFrame, slack: dict[str, int] = SLACK, reach: int = REACH,
               min_group: int = MIN_GROUP) -> DataFrame:
    """Per language and source: _most, a map from measure to its highest usual value, and _least."""
    own = _quartiles(sketch, KEY)
    wide = {"lang": (["_l0", "_l"], "l_"), "all": ([], "a_")}
    out = own
    for by, prefix in wide.values():
        merged = _quartiles(sketch, by)
        out = out.join(merged.select(*by, "measure", *[F.col(c).alias(prefix + c) for c in ("total", "q1", "q3")]),
                       [*by, "measure"])
    pick = {q: F.when(F.col("total") >= min_group, F.col(q)).when(F.col("l_total") >= min_group, F.col("l_" + q))
            .otherwise(F.col("a_" + q)) for q in ("q1", "q3")}
    room = F.lit(0)
    for name, least in slack.items():
        room = F.when(F.col("measure") == name, F.greatest((F.col("_q3") - F.col("_q1")) * reach, F.lit(least))).otherwise(room)
    bounds = (out.withColumns({"_q1": pick["q1"], "_q3": pick["q3"]}).withColumn("_room", room)
              .groupBy(*KEY).pivot("measure", list(slack))
              .agg(F.max(F.col("_q3") + F.col("_room")).alias("most"), F.min(F.col("_q1") - F.col("_room")).alias("least")))
    return bounds.select(*KEY, *[F.col(f"{m}_{e}").alias(f"_{m}_{e}") for m in slack for e in ("most", "least")])


def base_failed() -> Column:
    return ((F.col("_m.n_words") < MIN_WORDS)
            | (F.col("_m.n_repeat_words") * 100 > F.col("_m.n_words") * MOST_REPEATED))


def usual() -> Column:
    """Whether every measure of the row lies within the bounds of its language and source."""
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & (value <= F.coalesce(F.col(f"_{name}_most"), F.lit(0)))
        if name == "word_length":
            inside = inside & (value >= F.coalesce(F.col(f"_{name}_least"), F.lit(0)))
    return inside


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Measured rows with KEY columns, plus _failed and _kept."""
    joined = rows.join(bounds, KEY, "left")
    kept = ~base_failed() & usual()
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], base_failed().alias("_failed"), kept.alias("_kept"))


@apart("lang", "source", "text", "carry")
def verdicts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
             carry: list[str] | None = None) -> DataFrame:
    """One row per document: the `carry` columns, _m, _failed, _kept. Texts are read once.

    Null languages and sources are groups of their own. A null or empty text has no words and
    fails the base rule. Equal rows get equal verdicts. An empty table gives no rows.
    """
    slim = docs.select(*[F.col(f"`{c}`") for c in carry or []], *[c.alias(k) for k, c in _group(lang, source).items()],
                       text_or_empty(text).alias("_text"))
    rows = stored(measured(slim, "_text").drop("_text"), "measures")
    return judged(rows, thresholds(sketches(rows)))


@apart("lang", "source", "text")
def keep_documents(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their columns; see `verdicts` for the rules."""
    grouped = docs.withColumns(_group(lang, source))
    slim = grouped.select(*KEY, text_or_empty(text).alias("_text"))
    bounds = thresholds(stored(sketches(measured(slim, "_text").drop("_text")), "sketches"))
    return judged(measured(grouped, text), bounds).where("_kept").select(*[F.col(f"`{c}`") for c in docs.columns])

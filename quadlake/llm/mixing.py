"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm.common import WORD_PATTERN, apart, stored, text_or_empty

#: Equal ranges of the 64-bit key space. Keys are hash-random, so equal ranges hold equal shares.
SLICES = 4096
#: Rows a slice should hold; more rows make more slices.
SLICE_ROWS = 65_536
#: Up to so many sources, with names of so many bytes, the shares of the mix are sent to every task.
FEW_SOURCES = 10_000
FEW_BYTES = 1 << 22
#: Beyond that the rows of a source are dealt to so many tasks, and its share is sent to each.
SALTS = 64


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD_PATTERN)).cast("bigint")


def _named(source: str) -> tuple[Column, Column]:
    """A source as two columns without nulls; nulls order last."""
    return (F.col(source).isNull().cast("int").alias("_none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name"))


def keyed(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Add _none/_name (the source), _size (words) and _key, a hash-random key of the whole row."""
    flat = [c for c in docs.columns if not docs.schema[c].dataType.typeName() == "map"]
    return docs.select("*", *_named(source), word_count(text).alias("_size"),
                       F.xxhash64(*[F.col(f"`{c}`") for c in flat], F.lit("mix")).alias("_key"))


def targets(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
            most_epochs: float = 2.0) -> DataFrame:
    """Per source: _none, _name, source_size, target.

    Sources in code point order, null last, take the weights in turn. A source's cap is
    `most_epochs` times its size; what it can't take is shared again by weight. In order of
    cap / weight that has a closed form: the level at which all uncapped sources stand.
    """
    sizes = rows.groupBy("_none", "_name").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy("_none", "_name")
    turn = (F.row_number().over(order) - 1) % len(weights)
    level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_none", "_name")
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    weighed = (sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                        (turn + 1).cast("int")))
               .withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs))))
    # Standing at the level of this row: what the sources before it leave, by weight of the rest.
    stood = (weighed.withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(share)))
             .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             .withColumn("_at", F.col("_left") / F.sum("_weight").over(rest))
             .withColumn("_open", F.col("_at") * F.col("_weight") < F.col("_cap"))
             .withColumn("_level", F.max(F.when(F.col("_open"), F.col("_at"))).over(whole)))
    return stood.select("_none", "_name", "source_size",
                        F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
                        .alias("target"))


def cuts(rows: DataFrame, wanted: DataFrame, slices: int = SLICES) -> DataFrame:
    """Per source: _epochs (whole passes), _cut (the key at which the last pass ends) and
    _part (words taken from each row with that key).

    Rows are dealt by (source, range of keys), sorted inside it, and summed; the totals of a
    source's ranges, at most `slices` rows, give the ranges' offsets. So no task sorts a source.
    """
    width = (1 << 64) // slices
    # Arithmetic in doubles would blur the ranges; shift the signed key instead.
    bits = width.bit_length() - 1
    at = F.shiftright(F.col("_key"), bits)
    by_key = (rows.groupBy("_none", "_name", at.alias("_slice"), "_key")
              .agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows")))
    totals = by_key.groupBy("_none", "_name", "_slice").agg(F.sum("_words").alias("_in"))
    earlier = (Window.partitionBy("_none", "_name").orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumn("_from", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    budget = wanted.select("_none", "_name",
                           F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(0).cast("bigint").alias("_epochs"),
                           F.round("target").cast("bigint").alias("_words_wanted"), "source_size")
    budget = budget.withColumn("_budget", F.greatest(
        F.col("_words_wanted") - F.col("_epochs") * F.col("source_size"), F.lit(0)))
    within = (Window.partitionBy("_none", "_name", "_slice").orderBy("_key")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    crossing = (offsets.join(budget, ["_none", "_name"])
                .where("_budget > _from and _budget <= _from + _in"))
    ends = (by_key.join(crossing, ["_none", "_name", "_slice"])
            .withColumn("_upto", F.col("_from") + F.sum("_words").over(within))
            .where("_upto >= _budget and _upto - _words < _budget")
            .select("_none", "_name", F.col("_key").alias("_cut"),
                    F.floor((F.col("_budget") - F.col("_upto") + F.col("_words")) / F.col("_rows"))
                    .cast("bigint").alias("_part")))
    return budget.select("_none", "_name", "_epochs").join(ends, ["_none", "_name"], "left")


@apart("source", "text")
def mix(docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[int] = (5, 2, 1),
        share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """Add _size, source_size, target and taken: how many words of each document the mix takes.

    Every document's hash gives its place in its source. A source is passed whole as often as
    its budget holds it, then up to the exact word of the budget. A null text has size 0; null
    sources are one source, ordered last; a source without words takes nothing. Rows equal in
    every column share a key, and the cut gives each an equal part. Empty tables give no rows.
    Columns of the caller named as one returned here (_none, _name, _size and _key too) are
    replaced. Reruns agree: keys depend on the rows alone.
    """
    return _mixed(docs, source, text, weights, share, most_epochs)


def _mixed(docs: DataFrame, source: str, text: str, weights: Sequence[int], share: float, most_epochs: float) -> DataFrame:
    rows = keyed(docs, source, text)
    slim = stored(rows.select("_none", "_name", "_size", "_key"), "sizes")
    wanted = targets(slim, weights, share, most_epochs)
    slices = max(SLICES, 1 << (slim.count() // SLICE_ROWS).bit_length())
    return _taken(rows, wanted, cuts(slim, wanted, slices))


def _taken(rows: DataFrame, wanted: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows with what the mix takes of them. The texts stay where they are if the sources are few."""
    last = (F.when(F.col("_cut").isNull(), F.lit(0)).when(F.col("_key") < F.col("_cut"), F.col("_size"))
            .when(F.col("_key") == F.col("_cut"), F.least("_part", "_size")).otherwise(0))
    shares = stored(wanted.join(ends, ["_none", "_name"]), "shares")
    held = shares.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_name")), F.lit(0)).alias("size")).first()
    if held.n <= FEW_SOURCES and held.size <= FEW_BYTES:
        met = rows.join(F.broadcast(shares), ["_none", "_name"])
    else:
        dealt = shares.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")
        met = rows.withColumn("_salt", salt).join(dealt, ["_none", "_name", "_salt"]).drop("_salt")
    return met.withColumn("taken", (F.col("_epochs") * F.col("_size") + last).cast("bigint"))


@apart("source", "text")
def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text",
                    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """The mix itself: every document as often as it is taken; the one at the cut stays whole.

    Documents without words are neither wanted nor counted and go.
    """
    taken = _mixed(docs, source, text, weights, share, most_epochs)
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("taken") / F.col("_size"))).otherwise(0).cast("int")
    return (taken.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies)))
            .where(F.col("_copy") > 0).select(*[F.col(f"`{c}`") for c in docs.columns]))

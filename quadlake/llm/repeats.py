"""Windows of documents that also start earlier: what the two substring operators share.

Every window has one anchor, found from the window's content alone, so equal windows have equal
anchors. Windows of a text with one anchor are a run; runs meet by their anchor's key, and only
runs whose key occurs more than once go on. Equal runs are told once, with their first place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.common import NO_ID, KeyFilter, Tally, batch, free_shuffles, retire, signed, stored, text_or_empty

_KEYS = pa.schema([("k", pa.int64()), ("n", pa.int64())])
_RUNS = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("o", pa.int64()), ("g", pa.int64()), ("a", pa.int32()), ("n", pa.int32())])
_CONTENTS = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("o", pa.int64()), ("a", pa.int32()), ("content", pa.binary())])
_CUTS = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("o", pa.int64()), ("a", pa.int32()), ("i", pa.int32()), ("j", pa.int32())])

#: Seconds in which Spark's cleaner, which works in the background, removes the shuffle files of plans that are done.
CLEANING = 2.0
#: Shares of the keys whose runs are joined with their first places one after the other.
PARTS = 3

#: Texts handled at once, in bytes.
AT_ONCE = 1 << 18


class Runs(NamedTuple):
    """Runs of windows: number of the text, key, first window, number of windows, hash of the content."""

    text: np.ndarray
    key: np.ndarray
    first: np.ndarray
    count: np.ndarray
    hash: np.ndarray
    content: Callable[[int], bytes]


#: Keys of texts to count; and, with a filter of the keys that occur more than once, the runs of
#: windows that may repeat.
Keys = Callable[[list[bytes]], np.ndarray]
Found = Callable[[list[bytes], Callable[[np.ndarray], np.ndarray]], Runs | None]


def _parts(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], int]]:
    """Texts of a batch, some at once, and the number of the first."""
    group, size, first = [], 0, 0
    for i, t in enumerate(b.column("text").to_pylist()):
        group.append(t.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= AT_ONCE:
            yield group, first
            group, size, first = [], 0, i + 1
    if group:
        yield group, first


def _count(keys: Keys):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in rows:
            for texts, _ in _parts(b):
                for k, n in tally.add(keys(texts)):
                    yield batch(_KEYS, k=signed(k), n=n)
        for k, n in tally.flush():
            yield batch(_KEYS, k=signed(k), n=n)

    return run


def _meet(found: Found, shared, wanted=None):
    """Runs whose key occurs more than once; with `wanted`, those named by it, with their content."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            orders, groups = b.column("o").to_numpy(), b.column("g").to_numpy()
            for texts, begin in _parts(b):
                got = found(texts, shared.value.has)
                if got is None:
                    continue
                at = got.text + begin
                k, c, a = signed(got.key), signed(got.hash), got.first
                o, g = orders[at], groups[at]
                if wanted is None:
                    yield batch(_RUNS, k=k, c=c, o=o, g=g, a=a.astype(np.int32), n=got.count.astype(np.int32))
                    continue
                hit = np.flatnonzero(wanted.value.has((k ^ c ^ o ^ (a << 40)).view(np.uint64)))
                if len(hit):
                    yield batch(_CONTENTS, k=k[hit], c=c[hit], o=o[hit], a=a[hit].astype(np.int32),
                                content=[got.content(i) for i in hit.tolist()])

    return run


#: A run's name, as a value to filter by; the same as in `_meet`.
NAME = "k ^ c ^ o ^ shiftleft(cast(a as bigint), 40)"


def by_window(runs: DataFrame, step: int, width: int) -> DataFrame:
    """(k, c, o, a, fo, fa): the first place of each window of each run, by grouping single windows."""
    count = F.floor((F.length("content") - width) / step + 1).cast("int")
    cut = runs.select("k", "c", "o", "a", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    single = cut.select("k", "c", "o", "a", "i", F.struct("o", (F.col("a") + F.col("i")).alias("a")).alias("at"),
                        F.substring(F.col("content"), F.col("i") * step + 1, F.lit(width)).alias("w"))
    first = single.groupBy("w").agg(F.min("at").alias("first"))
    back = single.join(first, "w").groupBy("k", "c", "o", "a").agg(
        F.array_sort(F.collect_set(F.struct("i", "first"))).alias("all"))
    return back.select("k", "c", "o", "a", F.expr("transform(all, x -> x.first.o)").alias("fo"),
                       F.expr("transform(all, x -> x.first.a)").alias("fa"))


def _cuts(width: int, same: bool):
    """(k, c, o, a, i, j): parts of runs, with the place they are told at, whose windows start earlier in other runs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            k, c, o, a = (b.column(x).to_numpy() for x in ("k", "c", "o", "a"))
            size = pc.list_value_length(b.column("fo")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(o)), size)
            if not len(row):
                continue
            i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            fo = pc.list_flatten(b.column("fo")).to_numpy()
            gone = fo < o[row]
            if same:
                gone |= (fo == o[row]) & (pc.list_flatten(b.column("fa")).to_numpy() < a[row] + i)
            follows = gone[1:] & gone[:-1] & (row[1:] == row[:-1])
            s = np.flatnonzero(gone & ~np.append(False, follows))
            e = np.flatnonzero(gone & ~np.append(follows, False))
            yield batch(_CUTS, k=k[row[s]], c=c[row[s]], o=o[row[s]], a=a[row[s]], i=i[s].astype(np.int32), j=(i[e] + width).astype(np.int32))

    return run


def _cleaned(spark: SparkSession) -> None:
    """Shuffle files of what is done are gone before the next step writes its own."""
    free_shuffles(spark)
    time.sleep(CLEANING)


def place(doc_id: str) -> Column:
    """Documents in order of their ids; those without one come last."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))


def repeated_spans(docs: DataFrame, keys: Keys, found: Found, solve: Callable[[DataFrame], DataFrame],
                   units: int, same: bool, doc_id: str, text: str) -> DataFrame:
    """(g, _spans): by row key, spans covered by windows that also start earlier, each as start << 32 | end.

    units: a window's length in the text's units;
    same: whether an earlier start in the same document counts. solve gives (k, c, o, a, fo, fa), the
    first place of each window, for runs that share their key with a different run. A run whose
    content starts earlier goes as a whole; only the first of equal runs needs the places.
    """
    spark = docs.sparkSession
    own = docs.select(text_or_empty(text).alias("text"), place(doc_id).alias("o"), row_key(doc_id, text).alias("g"))
    shared = stored(own.select("text").mapInArrow(_count(keys), "k long, n long").groupBy("k")
                    .agg(F.sum("n").alias("n")).where("n > 1").select("k"), "keys")
    _cleaned(spark)
    known = spark.sparkContext.broadcast(KeyFilter.of(shared, "k"))
    # The filter lets a few others pass; they meet nothing here.
    met = stored(own.mapInArrow(_meet(found, known), "k long, c long, o long, g long, a int, n int"), "runs")
    retire(shared)
    told = stored(met.groupBy("k", "c").agg(F.min(F.struct("o", "a")).alias("at")).select("k", "c", "at.o", "at.a"), "told")
    _cleaned(spark)
    several = told.groupBy("k").count().where("count > 1").select("k")
    some = stored(told.join(several, "k", "left_semi"), "several")
    wanted = spark.sparkContext.broadcast(KeyFilter.of(some.select(F.expr(NAME).alias("name")), "name"))
    # Only runs that differ from another of their key, told once each, are read again with their content.
    content = stored(own.mapInArrow(_meet(found, known, wanted), "k long, c long, o long, a int, content binary"), "contents")
    known.destroy()
    wanted.destroy()
    cuts = stored(solve(content).mapInArrow(_cuts(units, same), "k long, c long, o long, a int, i int, j int").distinct()
                  .groupBy("k", "c", "o", "a").agg(F.collect_list(F.struct("i", "j")).alias("cuts")), "cuts")
    retire(content)
    retire(some)
    _cleaned(spark)
    # Equal runs the second filter let pass have later places; what is cut there says nothing of the first one.
    first = (told.join(cuts, ["k", "c", "o", "a"], "left")
             .select("k", "c", F.col("o").alias("first"), F.col("a").alias("at"), "cuts"))
    earlier = F.col("first") < F.col("o")
    if same:
        earlier |= (F.col("first") == F.col("o")) & (F.col("at") < F.col("a"))
    whole = F.array(F.struct(F.lit(0).alias("i"), (F.col("n") - 1 + units).cast("int").alias("j")))
    spans = None
    for part in range(PARTS):  # one share of the keys at a time: what moves at once is that much less
        mine = F.pmod("k", F.lit(PARTS)) == part
        some = stored(met.where(mine).join(first.where(mine), ["k", "c"]).where(earlier | F.col("cuts").isNotNull())
                      .select("g", "a", F.explode(F.when(earlier, whole).otherwise(F.col("cuts"))).alias("x"))
                      .select("g", F.expr("shiftleft(cast(a + x.i as bigint), 32) | (a + x.j)").alias("s")), "spans")
        spans = some if spans is None else spans.unionByName(some)
        _cleaned(spark)
    for done in (met, told, cuts):
        retire(done)
    return spans.groupBy("g").agg(F.collect_set("s").alias("_spans"))


def row_key(doc_id: str, text: str) -> Column:
    """The same for a text and its bytes."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def without_spans(docs: DataFrame, spans: DataFrame, cut: Callable[[str, np.ndarray | None], tuple], extra: str,
                  doc_id: str, text: str) -> DataFrame:
    """`docs` with the text that `cut` leaves, and the columns it counts."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + extra
    added = [x.split()[0] for x in extra.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            spans = b.column("_spans")
            size = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            flat, ends = pc.list_flatten(spans).to_numpy(), np.cumsum(size)
            done = [cut(t or "", flat[e - n:e] if n else None)
                    for t, n, e in zip(b.column(text).to_pylist(), size.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array([x[0] for x in done], pa.binary() if pa.types.is_binary(b.column(n).type) else pa.string())
                       if n == text else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array([x[i + 1] for x in done], pa.int64()) for i in range(len(added))]],
                names=[*names, *added])

    keyed = docs.withColumn("_g", row_key(doc_id, text)).join(spans.withColumnRenamed("g", "_g"), "_g", "left")
    return keyed.select(*[F.col(f"`{n}`") for n in names], "_spans").mapInArrow(run, schema)


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n units the spans (start << 32 | end) cover, as a mask."""
    edges = np.bincount(spans >> 32, minlength=n + 1) - np.bincount(spans & 0xFFFFFFFF, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0

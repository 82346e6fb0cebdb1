"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import KeyFilter, Tally, apart, batch, retire, signed, stored, text_key, text_or_empty, tidy

_COUNTS = pa.schema([("batch", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
_HITS = pa.schema([("_t1", pa.int64()), ("_t2", pa.int64()), ("key", pa.binary())])
MIN_DOCS = 10
BATCHES = 6
FAN_IN = 3


def line_keys(text: str, min_chars: int = 1) -> tuple[list[str], list[bytes | None]]:
    """The lines and their keys: blanks stripped at both ends, A-Z lower-cased; None if too short."""
    lines = text.split("\n")
    keys = [line.encode("utf-8", "surrogatepass").strip().lower() for line in lines]
    if min_chars <= 1:
        return lines, [k or None for k in keys]
    return lines, [k if len(k.decode("utf-8", "surrogatepass")) >= min_chars else None for k in keys]


class LineRuns:
    """How many documents hold each line, kept as levels of sorted runs (h, n).

    `settled` is the run of hashes already found in `min_docs` documents; they need no more
    counting. A new batch is merge-anti-joined with it and what is left becomes a run of level 0.
    When a level has `fan_in` runs they are merged into one run of the next level, and hashes that
    reach `min_docs` move to the settled run. A hash is moved once per level, so the work over all
    batches is n log n, and every run is a written table.
    """

    def __init__(self, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.min_docs, self.fan_in = min_docs, fan_in
        self.settled: DataFrame | None = None
        self.levels: list[list[DataFrame]] = []

    def add(self, counts: DataFrame) -> None:
        """Add a batch: (h, n), each h once."""
        if self.settled is not None:
            counts = counts.join(self.settled.hint("merge"), "h", "left_anti")
        self._put(stored(counts.select("h", "n").sortWithinPartitions("h"), "run"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            self._put(self._merge(runs), level + 1)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        merged = stored(rows.groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h"), "run")
        self._settle(merged.where(F.col("n") >= self.min_docs).select("h"))
        for run in runs:
            retire(run)
        return merged.where(F.col("n") < self.min_docs)

    def _settle(self, found: DataFrame) -> None:
        old = self.settled
        if old is not None:
            found = found.unionByName(old)
        self.settled = stored(found.distinct().sortWithinPartitions("h"), "settled")

    def finish(self) -> DataFrame:
        """Merge all levels; the hashes (h) found in at least `min_docs` documents."""
        runs = [run for level in self.levels for run in level]
        self.levels = []
        if runs:
            self._merge(runs)
        return self.settled


def _counts(min_chars: int, batches: int):
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally(2_000_000 // batches) for _ in range(batches)]

        def out(i, found):
            for keys, n in found:
                yield batch(_COUNTS, batch=np.full(len(keys), i, np.int32), h=signed(keys), n=n)

        for b in rows:
            for text, i in zip(b.column("text").to_pylist(), b.column("batch").to_pylist(), strict=True):
                keys = set(line_keys(text, min_chars)[1]) - {None}
                got = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                yield from out(i, tallies[i].add(got))
        for i, tally in enumerate(tallies):
            yield from out(i, tally.flush())

    return count


def _suspects(min_chars: int, known):
    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            _t1, _t2, keys = [], [], []
            for text, a, c in zip(*(b.column(n).to_pylist() for n in ("text", "_t1", "_t2")), strict=True):
                own = list(set(line_keys(text, min_chars)[1]) - {None})
                if not own:
                    continue
                hit = known.value.has(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                for i in np.flatnonzero(hit):
                    _t1.append(a)
                    _t2.append(c)
                    keys.append(xxhash.xxh3_128_digest(own[i]))
            yield batch(_HITS, _t1=_t1, _t2=_t2, key=keys)

    return find


def _rewrite(min_chars: int):
    def keep(text: str, drop: list[bytes] | None) -> tuple[int, int, str]:
        if not drop:
            return text.count("\n") + 1, 0, text
        gone = set(drop)
        lines, keys = line_keys(text, min_chars)
        left = [line for line, k in zip(lines, keys, strict=True)
                if k is None or xxhash.xxh3_128_digest(k) not in gone]
        return len(lines), len(lines) - len(left), "\n".join(left)

    return keep


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1,
                   batches: int = BATCHES) -> DataFrame:
    """(_t1, _t2, _drop): by text, the 128-bit keys of its lines that at least `min_docs` rows hold."""
    spark = docs.sparkSession
    own = docs.select(text_or_empty(text).alias("text"))
    dealt = own.select("text", F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"))
    counted = stored(dealt.mapInArrow(tidy(_counts(min_chars, batches)), "batch int, h long, n long")
                     .groupBy("batch", "h").agg(F.sum("n").alias("n")), "lines")
    runs = LineRuns(min_docs)
    for i in range(batches):
        runs.add(counted.where(F.col("batch") == i).select("h", "n"))
    settled = runs.finish()
    retire(counted)
    # The runs hold 64-bit hashes; lines they point at are counted again by 128 bits.
    known = spark.sparkContext.broadcast(KeyFilter.of(settled, "h"))
    hits = stored(text_key(own, "text").mapInArrow(tidy(_suspects(min_chars, known)),
                                                    "_t1 long, _t2 long, key binary"), "hits")
    sure = hits.groupBy("key").count().where(F.col("count") >= min_docs).select("key")
    return hits.join(sure, "key", "left_semi").groupBy("_t1", "_t2").agg(F.collect_set("key").alias("_drop"))


@apart("text")
def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """`docs` with `text` without its frequent lines, and _n_lines, _n_dropped.

    A null or empty text is one empty line and stays as it is. Equal rows are separate documents.
    Lines are told apart by 128-bit hashes of their keys. An empty table gives an empty table.
    """
    drops = frequent_lines(docs, text, min_docs, min_chars)
    keep = _rewrite(min_chars)
    marked = text_key(docs, text).join(drops, ["_t1", "_t2"], "left")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _n_lines long, _n_dropped long"

    def rewrite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            old = b.column(text).to_pylist()
            done = [keep(t or "", d) for t, d in zip(old, b.column("_drop").to_pylist(), strict=True)]
            new = [t if not x[1] else x[2] for t, x in zip(old, done, strict=True)]
            columns = [pa.array(new, b.column(n).type) if n == text else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())],
                names=[*names, "_n_lines", "_n_dropped"])

    return marked.select(*[F.col(f"`{n}`") for n in names], "_drop").mapInArrow(tidy(rewrite), schema)


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()

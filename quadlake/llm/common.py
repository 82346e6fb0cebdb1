"""What the operators share: tables, written tables, word hashes, filters of fixed size, row batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
BLANKS = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1


def short_batches(spark: SparkSession) -> SparkSession:
    """Texts go to Python a thousand rows or 4 MB at a time: both sides hold whole batches, and so does the scan."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def apart(*roles: str) -> Callable:
    """For operators: the caller's columns go by numbers inside, so no name of theirs meets one made there.

    roles: the parameters that name columns (a name, or a list of names). Afterwards they have their names again;
    where the operator returns a column of its own under such a name, its own replaces the caller's.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        parameters = inspect.signature(operator)
        first = next(iter(parameters.parameters))

        @functools.wraps(operator)
        def run(*args, **named) -> DataFrame:
            given = parameters.bind(*args, **named)
            given.apply_defaults()
            docs = given.arguments[first]
            names = {f"given{i}": name for i, name in enumerate(docs.columns)}
            inside = {name: number for number, name in reversed(names.items())}
            given.arguments[first] = docs.toDF(*names)
            for role in roles:
                of = given.arguments[role]
                if of is not None:
                    given.arguments[role] = inside[of] if isinstance(of, str) else [inside[c] for c in of]
            out = operator(*given.args, **given.kwargs)
            made = {c.lower() for c in out.columns if c not in names}
            return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns
                                if c not in names or names[c].lower() not in made])

        return run

    return wrap


def text_key(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add _t1 and _t2, together a 128-bit hash of the text; null counts as empty."""
    whole = text_or_empty(text)
    return rows.withColumns({"_t1": F.xxhash64(whole), "_t2": F.xxhash64(whole, F.lit(1))})


# ---- written tables -------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows survives lost executors
    without running the plan so far again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def retire(df: DataFrame) -> None:
    """Delete the files of a table made by `stored` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(("/", "file:", "hdfs:", "s3", "abfs", "gs:")) and "-" in path.rsplit("/", 1)[1]:
            where = hadoop.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done: it does so for those the driver has collected."""
    gc.collect()
    spark._jvm.System.gc()


# ---- words ----------------------------------------------------------------------------------

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                  0xD6E8FEB86659FD93], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[ord(c) for c in BLANKS]] = False
_POWERS: list[np.ndarray] = []
#: Bytes of texts hashed at once.
_AT_ONCE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from 0 to n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, _AT_ONCE) + 1
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of `data`, their starts and ends: polynomials over random byte values."""
    chars = np.frombuffer(data, np.uint8)
    inside = _IS_WORD[chars]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    return range_hashes(_BYTE[chars], starts, ends), starts, ends


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of 64-bit values: differences of one running polynomial."""
    power, inverse = _powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_rows(texts: list[str], lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; many texts are hashed at once."""
    group, size = [], 0

    def flush():
        data = b"\n".join(group)
        h, starts, _ = word_hashes(data.lower() if lower else data)
        begins = np.cumsum([0] + [len(x) + 1 for x in group])
        at = np.searchsorted(starts, begins)
        for i in range(len(group)):
            yield h[at[i]:at[i + 1]]

    for t in texts:
        group.append(t.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= _AT_ONCE:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def shingle_sets(texts: list[str], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's `width`-word shingles; the whole sequence if there are fewer words."""
    for h in word_rows(texts, lower=True):
        if not len(h):
            yield np.empty(0, np.uint64)
            continue
        take = min(width, len(h))
        out = np.zeros(len(h) - take + 1, np.uint64)
        for j in range(take):
            out += h[j:len(h) - take + 1 + j] * _MULT[j]
        if take < width:
            out += np.uint64(take)
        yield np.unique(mix(out))


# ---- batches --------------------------------------------------------------------------------

def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


class Tally:
    """Sums counts of 64-bit keys inside a task before they are shuffled, in bounded memory."""

    def __init__(self, limit: int = 1_000_000):
        self.parts, self.size, self.limit = [], 0, limit

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(keys):
            self.parts.append(keys)
            self.size += len(keys)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            keys, counts = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.size = [], 0
            for i in range(0, len(keys), 100_000):
                yield keys[i:i + 100_000], counts[i:i + 100_000]


# ---- a filter of fixed size -----------------------------------------------------------------

class KeyFilter:
    """Bloom filter over 64-bit keys, always of `bits` bits (16 MB), so it can be broadcast.

    It only saves rows from being shuffled: an exact join always follows, so a full filter
    costs time, never results.
    """

    bits = 1 << 27

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, col: str) -> KeyFilter:
        spread = F.xxhash64(F.col(col))
        places = F.explode(F.array(F.col(col), spread)).alias("k")
        at = F.col("k").bitwiseAND(cls.bits - 1)
        rows = (keys.select(places).select(F.shiftrightunsigned(at, 6).alias("w"),
                                           F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b"))
                .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
        words = np.zeros(cls.bits // 64, np.int64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy()
        return cls(words.view(np.uint64))

    def has(self, keys: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """keys: uint64."""
        hit = self._bit(keys)
        if hit.any():
            some = np.flatnonzero(hit)
            hit[some] = self._bit(spark_xxhash64(keys[some]))
        return hit

    def _bit(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.bits - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def spark_xxhash64(keys: np.ndarray) -> np.ndarray:
    """xxhash64 of one 64-bit value with seed 42, as Spark's function of that name."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P[4] + np.uint64(8)
        h = h ^ (_rotl(keys * _P[1], 31) * _P[0])
        h = _rotl(h, 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        return h ^ (h >> np.uint64(32))


def _give_back() -> None:
    """Return memory that is free to the system: pyarrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """`run`, a function over batches, that leaves no free memory behind: its worker lives on between tasks and steps."""

    @functools.wraps(run)
    def tidied(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(rows)
        finally:
            _give_back()

    return tidied


def texts(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)

"""Byte-level BPE: overlapping chunks, stitched where their pre-token boundaries meet."""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadlake.llm.common import apart, text_key, text_or_empty, tidy

#: Code points a chunk starts after the one before it, and how far it reaches into the next.
CHUNK = 30_000
OVERLAP = 512
CACHE = 200_000
#: Bytes up to which a piece is merged by looking through all its pairs.
FEW = 64
NO_RANK = 1 << 31


class Vocabulary(dict):
    """Piece (a str) to its ids, filled as pieces come.

    When it is full it starts anew and takes over from the full one what is asked for again, so
    frequent pieces stay and memory is bounded.
    """

    def __init__(self, lines: list[bytes]):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        self[piece] = ids
        return ids

    def forget(self) -> None:
        """Drop the pieces; the ranks stay."""
        self.clear()
        self.older = {}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Join the adjacent pair of lowest rank, leftmost first, until no pair has one.

    Parts are a linked list and pairs a heap, so a piece of any length takes n log n steps; short ones need neither.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n <= FEW:
        return _merge_few(piece, ranks)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i] if alive[i] else n
        if j >= n or not alive[i] or ends[j] != end:
            continue
        ends[i], alive[j] = end, False
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i:ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return tuple(out)


def _merge_few(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i:i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return tuple(map(ranks.__getitem__, parts))


_LOADED: dict[str, tuple] = {}


def _tools(spec) -> tuple:
    """The vocabulary and pattern of a broadcast, built once in each worker.

    A worker lives on between steps and queries, so it keeps the last one only.
    """
    if spec.id not in _LOADED:
        _LOADED.clear()
        lines, pattern = spec.value
        _LOADED[spec.id] = Vocabulary(lines), regex.compile(pattern)
    return _LOADED[spec.id]


class Spec:
    """A broadcast (lines of the rank file, pattern) and its id, the same for the same contents; the file has a fixed size."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            ranks = file.read()
        self._value = spark.sparkContext.broadcast((ranks.splitlines(), pattern))
        self.id = hashlib.sha256(ranks + b"\0" + pattern.encode()).hexdigest()

    @property
    def value(self):
        return self._value.value


def encode_pieces(pieces: list[str], vocabulary: Vocabulary) -> list[int]:
    return list(chain.from_iterable(map(vocabulary.__getitem__, pieces)))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _plain(ids: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column, made from its flat values (far faster than list by list)."""
    ends = ids.offsets.to_numpy()
    flat = ids.values.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield flat[a:b].tolist()


def decode(ids, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))


def _encoded_schema(docs: DataFrame, names: list[str]) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return f"{own}{', ' if own else ''}ids array<int>"


def _short(spec, names: list[str], text: str = "_text"):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pattern = _tools(spec)
        for b in rows:
            for part in _slices(b):
                ids = [encode_pieces(pattern.findall(t or ""), vocabulary) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], _lists(ids)],
                                                 names=[*names, "ids"])

    return run


def _lost(spec, names: list[str]):
    """Rows with their ids as they are; those whose chunks could not be stitched are encoded whole."""
    whole = _short(spec, names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            known = b.column("ids").is_valid()
            done = b.filter(known)
            yield pa.RecordBatch.from_arrays([*[done.column(n) for n in names], done.column("ids").cast(pa.list_(pa.int32()))],
                                             names=[*names, "ids"])
            rest = b.filter(pc.invert(known))
            if rest.num_rows:
                yield from whole(iter([rest]))

    return run


def _slices(b: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def pieces_and_ends(text: str, pattern) -> tuple[list[str], list[int]]:
    pieces = pattern.findall(text)
    ends = list(accumulate(map(len, pieces)))
    if ends and ends[-1] != len(text):  # the pattern left something out: ends are no sums
        ends = [m.end() for m in pattern.finditer(text)]
    return pieces, ends


def boundaries(text: str, pattern, start: int, last: bool) -> list[int]:
    """Where pre-tokens end, as offsets in the document, if the text begins at one.

    Within a chunk that is not the last, matches that touch its end may be cut and don't count;
    the match before them may depend on what it could see, so it doesn't count either.
    """
    _, ends = pieces_and_ends(text, pattern)
    if not last:
        while ends and ends[-1] >= len(text):
            ends.pop()
        if ends:
            ends.pop()
    return [start + e for e in ends]


def _chunk_ends(spec, size: int, overlap: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern = _tools(spec)
        for b in rows:
            heads, tails = [], []
            for text, k, n in zip(*(b.column(c).to_pylist() for c in ("chunk", "k", "n_chunks")), strict=True):
                found = boundaries(text, pattern, k * size, k == n - 1)
                heads.append([e for e in found if e < k * size + overlap] if k else [])
                tails.append([e for e in found if e > (k + 1) * size])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=[*b.schema.names, "heads", "tails"])

    return run


def _encode_ranges(spec, size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pattern = _tools(spec)
        for b in rows:
            out = []
            for text, k, begin, end in zip(*(b.column(c).to_pylist() for c in ("chunk", "k", "begin", "end")), strict=True):
                # From a boundary on, the pieces are those of the document; the next chunk goes on at `end`.
                piece = text[begin - k * size:]
                stop = len(piece) if end is None else end - begin
                pieces, ends = pieces_and_ends(piece, pattern)
                out.append(encode_pieces(pieces[:bisect_left(ends, stop) + 1] if stop > 0 else [], vocabulary))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_t1", "_t2", "k")], _lists(out)],
                                             names=["_t1", "_t2", "k", "ids"])

    return run


@apart("text")
def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """`docs` and `ids`, the token ids of every text (null: empty, no ids).

    A text of one chunk is encoded where it is read. A longer one becomes overlapping chunks that
    are pre-tokenised in parallel, each as if it began at a boundary. Where two neighbours have a
    boundary in common inside their overlap, both go on alike, as a pre-token depends only on what
    follows its start; there they are stitched, and each chunk's pieces from stitch to stitch are
    encoded. A document with an overlap without a common boundary (one giant pre-token) is
    pre-tokenised whole. Equal rows stay separate. An empty table gives an empty table.
    A column of `docs` named ids is replaced.
    """
    spec = Spec(docs.sparkSession, ranks_path, pattern)
    names = [c for c in docs.columns if c != "ids"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text).alias("_text"))
    schema = _encoded_schema(docs, names)
    # A text that is a string goes to Python once, as the column it is.
    given = text if text in names and isinstance(docs.schema[text].dataType, StringType) else "_text"
    short = (rows.where(F.length("_text") <= chunk).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, given])])
             .mapInArrow(tidy(_short(spec, names, given)), schema))

    # Equal long texts are encoded once: their hash is the key of chunks and results.
    long = text_key(rows.where(F.length("_text") > chunk), "_text")
    n_chunks = F.ceil(F.length("_text") / F.lit(chunk)).cast("int")
    chunks = (long.select("_t1", "_t2", "_text", n_chunks.alias("n_chunks"),
                          F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("k"))
              .select("_t1", "_t2", "k", "n_chunks",
                      F.substring(F.col("_text"), F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("chunk"))
              .dropDuplicates(["_t1", "_t2", "k"]))
    ended = chunks.mapInArrow(tidy(_chunk_ends(spec, chunk, overlap)), "_t1 long, _t2 long, k int, n_chunks int, "
                              "chunk string, heads array<int>, tails array<int>")
    along = Window.partitionBy("_t1", "_t2").orderBy("k")
    meet = F.array_min(F.array_intersect("tails", F.lead("heads").over(along)))
    stitched = (ended.withColumn("meet", meet)
                .withColumn("lost", F.max(F.col("meet").isNull() & (F.col("k") < F.col("n_chunks") - 1))
                            .over(Window.partitionBy("_t1", "_t2")))
                .withColumn("begin", F.coalesce(F.lag("meet").over(along), F.lit(0)))
                .select("_t1", "_t2", "k", "chunk", "lost", "begin", F.col("meet").alias("end")))
    parts = (stitched.where("not lost").select("_t1", "_t2", "k", "chunk", "begin", "end")
             .mapInArrow(tidy(_encode_ranges(spec, chunk)), "_t1 long, _t2 long, k int, ids array<int>")
             .groupBy("_t1", "_t2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))),
                                                            lambda x: x["ids"])).alias("ids")))
    # One pass over the join: read twice, for rows with and without ids, all chunks would be encoded twice.
    moved = long.drop("_text") if given == text else long
    again = text_or_empty(text) if given == text else F.col("_text")
    whole = (moved.join(parts, ["_t1", "_t2"], "left")
             .select(*[F.col(f"`{c}`") for c in names], F.when(F.col("ids").isNull(), again).alias("_text"), "ids"))
    return short.unionByName(whole.mapInArrow(tidy(_lost(spec, names)), schema))


def digests(encoded: DataFrame, ranks_path: str, pattern: str, carry: list[str], last: bool = False) -> DataFrame:
    """`carry` columns, n_tokens, ids_sha256 and decoded_sha256 of rows with `ids`.

    Carried columns with these names are replaced; `ids` may be carried. last: the encoding is done (a written table),
    so workers drop the pieces they remember, which decoding doesn't need and later steps would carry along.
    """
    carry = [c for c in carry if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    spec = Spec(encoded.sparkSession, ranks_path, pattern)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in carry)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _tools(spec)
        if last:
            vocabulary.forget()
        digits = vocabulary.digits_of.__getitem__
        for b in rows:
            counts, of_ids, of_text = [], [], []
            for ids in _plain(b.column("ids")):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(decode(ids, vocabulary)).hexdigest())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(counts, pa.int64()),
                                              pa.array(of_ids), pa.array(of_text)],
                                             names=[*carry, "n_tokens", "ids_sha256", "decoded_sha256"])

    needed = [F.col(f"`{c}`") for c in dict.fromkeys([*carry, "ids"])]
    return encoded.select(*needed).mapInArrow(tidy(run), f"{own}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Documents cut into pieces of tokens, and pieces packed into few sequences."""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from quadlake.llm.common import retire, stored, text_or_empty

CAPACITY = 4096
#: The id that ends a document.
END = 1
#: Pieces packed by one task.
GROUP = 8192
#: A sequence filled to this share is left alone by later rounds.
DONE = 0.97
#: Turns over all underfull sequences of a group.
PASSES = 8
#: Chunks of text whose ids a worker remembers; when there are more it starts anew with those asked for again.
CACHE = 600_000

_PIECES = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"}
_SEPARATOR = "\x01"
#: White space to one library but not to the other, the separator, and a letter whose lower case depends on its place.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", _SEPARATOR)
_MARKS = frozenset(".,;:!?")


# ---- tokens ---------------------------------------------------------------------------------

class Encoder:
    """Ids of texts, as little-endian 32-bit numbers in bytes, by a tokenizer of words split on white space.

    Neither pieces of the pattern nor the normal form reach across white space, so the ids of a text are
    those of its chunks between white space, remembered by chunk. Unknown chunks are encoded many at once.
    Texts in which that is not so (special tokens, odd white space) are encoded whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        found = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.separator = found[0] if len(found) == 1 else None
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words in normal form, of letters alone, are pieces as they are.
        self.words = Tokenizer.from_str(json.dumps(json.loads(spec) | {"normalizer": None}))
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks: list[list[str] | None] = []
        for t in texts:
            lower = (t if t.isascii() else unicodedata.normalize("NFC", t)).lower()
            odd = self.separator is None or any(c in t for c in _ODD) or any(c in lower for c in self.special)
            chunks.append(None if odd else lower.split())
        self._learn(chunks)
        ids = self.known.__getitem__
        return [self.whole(t) if c is None else b"".join(map(ids, c)) for t, c in zip(texts, chunks, strict=True)]

    def _learn(self, chunks: list[list[str] | None]) -> None:
        wanted: set[str] = set()
        for c in chunks:
            wanted.update(c or ())
        if len(self.known) + len(wanted) > CACHE:
            self.older, self.known = self.known, {}
        missing = wanted.difference(self.known)
        for c in [c for c in missing if c in self.older]:
            self.known[c] = self.older[c]
            missing.discard(c)
        # A mark behind letters is a piece of its own.
        marked = [c for c in missing if c[-1] in _MARKS and c[:-1].isalpha()]
        ask = missing.difference(marked)
        for c in marked:
            ask.update((c[:-1], c[-1]))
        new = ask.difference(self.known)
        words = [c for c in new if c.isalpha()] if self.ends.any() else []
        self._ask(self.words, words, " ", self.ends)
        self._ask(self.tokenizer, list(new.difference(words)), f" {_SEPARATOR} ", None)
        for c in marked:
            self.known[c] = self.known[c[:-1]] + self.known[c[-1]]


    def _ask(self, tokenizer: Tokenizer, chunks: list[str], joint: str, ends: np.ndarray | None) -> None:
        """Remember the ids of chunks: they end where a word does, or before the separator."""
        for at in range(0, len(chunks), 20_000):
            some = chunks[at:at + 20_000]
            ids = np.array(tokenizer.encode_batch_fast([joint.join([*some, ""])], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(ids == self.separator if ends is None else ends[ids])
            begins = np.concatenate([[0], stops[:-1] + 1])
            stops = stops if ends is None else stops + 1
            raw = ids.tobytes()
            for c, a, b in zip(some, (4 * begins).tolist(), (4 * stops).tolist(), strict=True):
                self.known[c] = raw[a:b]


_LOADED: dict[str, Encoder] = {}


def _encoder(spec) -> Encoder:
    if spec.id not in _LOADED:
        _LOADED[spec.id] = Encoder(spec.value)
    return _LOADED[spec.id]


class _Spec:
    """A broadcast of the tokenizer's file, which has a fixed size."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as file:
            self._value = spark.sparkContext.broadcast(file.read())
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> str:
        return self._value.value


def _cut(spec, names: list[str], capacity: int, end: int, with_ids: bool):
    last = np.array([end], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for b in rows:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                of, made = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
                ids = []
                for i, raw in enumerate(encoder.encode(part.column("_text").to_pylist())):
                    raw += last
                    for k, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[begin:begin + 4 * capacity]
                        of.append(i)
                        made["piece"].append(k)
                        made["start"].append(begin // 4)
                        made["length"].append(len(piece) // 4)
                        made["ids_crc32"].append(zlib.crc32(piece))
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                arrays = [part.column(n).take(pa.array(of, pa.int32())) for n in names]
                arrays += [pa.array(made[n], pa.int32() if n == "piece" else pa.int64()) for n in made]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *made, *["ids"] * with_ids])

    return run


def cut(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end: int = END,
        with_ids: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row for each piece of a document's ids: its columns (all, or those to `carry`), piece (from 0), start (ids before it), length,
    ids_crc32 (of the ids as unsigned little-endian 32-bit numbers) and ids, unless they are not wanted.

    A document is its text's ids without special tokens, and then `end`; one longer than `capacity` is cut at its
    multiples. A null text is empty, and an empty one is its end alone. Texts of any length are encoded whole,
    equal rows are separate documents, an empty table gives no pieces. Columns of `docs` named as those made
    here are replaced; any others are carried, whatever their names.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in (*_PIECES, "ids")]
    made = [f"{n} {t}" for n, t in _PIECES.items()] + ["ids array<int>"] * with_ids
    safe = [f"_c{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(_quoted(c)).alias(s) for c, s in zip(names, safe, strict=True)], text_or_empty(text).alias("_text"))
    own = [f"{s} {docs.schema[c].dataType.simpleString()}" for c, s in zip(names, safe, strict=True)]
    pieces = rows.mapInArrow(_cut(_Spec(docs.sparkSession, tokenizer_path), safe, capacity, end, with_ids), ", ".join(own + made))
    return pieces.withColumnsRenamed(dict(zip(safe, names, strict=True)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---- packing one group ----------------------------------------------------------------------

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by sequence: longest first, each into the fullest sequence with room.

    Open sequences lie by their room; the bits of one number say which rooms there are.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, out = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = min(lengths[i], capacity)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            out[at].append(i)
        else:
            room, at = capacity, len(out)
            out.append([i])
        room -= size
        if room and not by_room[room]:
            rooms |= 1 << room
        if room:
            by_room[room].append(at)
    return out


class _Exchange:
    """Exchanges between underfull sequences that make the fuller of two fuller still."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.offers: dict[int, np.ndarray] = {}

    def _sums(self, b: int) -> list[tuple[int, ...]]:
        """Nothing, one or two lengths of a sequence, each combination once."""
        counts: dict[int, int] = {}
        for i in self.bins[b]:
            counts[self.lengths[i]] = counts.get(self.lengths[i], 0) + 1
        pairs = [p for p in combinations_with_replacement(sorted(counts), 2) if p[0] != p[1] or counts[p[0]] > 1]
        return [(), *((x,) for x in counts), *pairs]

    def _offer(self, b: int) -> np.ndarray:
        """Rows (sequence, room, what leaves, how many leave, first, second) of an underfull sequence."""
        if b not in self.offers:
            room = self.capacity - self.fill[b]
            self.offers[b] = np.array([(b, room, sum(s), len(s), *s, *[-1] * (2 - len(s))) for s in self._sums(b)], np.int64)
        return self.offers[b]

    def step(self, donor: int, others: list[int]) -> bool:
        """The exchange that takes most out of the donor: a move, one for one, two for one or one for two."""
        fuller = [b for b in others if b != donor and self.bins[b] and 0 < self.capacity - self.fill[b]
                  and self.fill[b] >= self.fill[donor]]
        if not fuller:
            return False
        table = np.concatenate([self._offer(b) for b in fuller])
        best, chosen = 0, None
        for given in self._sums(donor)[1:]:
            gain = sum(given) - table[:, 2]
            gain[(gain > table[:, 1]) | (table[:, 3] + len(given) > 3)] = 0
            at = int(gain.argmax())
            if gain[at] > best:
                best, chosen = int(gain[at]), (given, at)
        if chosen is None:
            return False
        given, at = chosen
        b, taken = int(table[at, 0]), [int(x) for x in table[at, 4:] if x >= 0]
        leaving, coming = [self._take(donor, x) for x in given], [self._take(b, x) for x in taken]
        self.bins[b] += leaving
        self.bins[donor] += coming
        for k, d in ((b, best), (donor, -best)):
            self.fill[k] += d
            self.offers.pop(k, None)
        return True

    def _take(self, b: int, length: int) -> int:
        at = next(k for k, i in enumerate(self.bins[b]) if self.lengths[i] == length)
        return self.bins[b].pop(at)


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by sequence: best fit, then exchanges that empty the least filled sequences.

    Each exchange makes the fuller of two sequences fuller, so the sum of squared fills grows and the search
    ends; it ends early when no fewer sequences can hold the lengths, or after `PASSES` turns.
    """
    bins = best_fit(lengths, capacity)
    least = -(-sum(lengths) // capacity)
    if len(bins) <= max(least, 1):
        return bins
    search, count = _Exchange(bins, lengths, capacity), len(bins)
    for _ in range(PASSES):
        open_ = sorted((b for b in range(len(bins)) if bins[b] and search.fill[b] < capacity), key=lambda b: (search.fill[b], b))
        changed = False
        for donor in open_:
            while bins[donor] and search.step(donor, open_):
                changed = True
            count -= not bins[donor]
            if count <= least:
                return [b for b in bins if b]
        if not changed:
            break
    return [b for b in bins if b]


# ---- packing everything ---------------------------------------------------------------------

_PLACED = "id long, length int, sequence_id long, offset long, done boolean, opens boolean"


def _pack(capacity: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(rows)
        if not batches:
            return
        held = pa.Table.from_batches(batches).sort_by("id")
        ids, lengths = held.column("id").to_pylist(), held.column("length").to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for b in packed(lengths, capacity):
            at, full = 0, sum(lengths[i] for i in b) >= DONE * capacity
            for k, i in enumerate(b):
                for column, value in zip(out, (ids[i], lengths[i], ids[b[0]], at, full, k == 0), strict=True):
                    column.append(value)
                at += lengths[i]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                         names=["id", "length", "sequence_id", "offset", "done", "opens"])

    return run


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset (columns so named are replaced): sequences of at most `capacity`,
    without gaps, as few as the search finds.

    Only ids and lengths are packed. They are dealt by hash to groups of about `GROUP`, each packed in its task
    by best fit and exchanges; sequences that stay underfull are dealt anew in the next round, until one group
    holds them or a round saves none. A piece that fills a sequence has it to itself, and so has a longer one. A null
    or negative length counts as 0. Pieces of equal length and equal rows are told apart by the order they are
    read in. An empty table stays empty.
    """
    uid = "_uid"
    while uid in pieces.columns:
        uid += "_"
    rows = stored(pieces.withColumn(uid, F.monotonically_increasing_id()), "pieces")
    size = F.greatest(F.coalesce(F.col(_quoted(length)), F.lit(0)), F.lit(0))
    sizes = rows.select(F.col(uid).alias("id"), size.alias("length"))
    alone = sizes.where(F.col("length") >= capacity).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting = sizes.where(F.col("length") < capacity).withColumn("length", F.col("length").cast("int"))
    kept, before, last = [alone], None, None
    while True:
        groups = -(-waiting.count() // GROUP)
        if not groups:
            break
        dealt = waiting.select("id", "length").repartition(groups, F.xxhash64("id", F.lit(len(kept))))
        placed = stored(dealt.mapInArrow(_pack(capacity), _PLACED), "placed")
        sums = placed.agg(F.count_if("opens").alias("bins"), F.count_if(F.col("opens") & ~F.col("done")).alias("open")).first()
        if before is not None and sums.bins >= before:
            kept.append(last)
            retire(placed)
            break
        if groups == 1 or not sums.open:
            kept.append(placed)
            break
        kept.append(placed.where("done"))
        waiting = last = placed.where("not done")
        before = sums.open
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more.select("id", "sequence_id", "offset"))
    own = [F.col(_quoted(c)) for c in pieces.columns if c not in ("sequence_id", "offset")]
    out = rows.join(found.withColumnsRenamed({"id": uid, "sequence_id": f"{uid}s", "offset": f"{uid}o"}), uid)
    return out.select(*own, F.col(f"{uid}s").alias("sequence_id"), F.col(f"{uid}o").alias("offset"))

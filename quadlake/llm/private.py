"""Personal data: fixed patterns, and a character-level BiLSTM with a CRF for what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import apart, stored, text_or_empty

#: Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The tagger is fitted on at most this many labelled pieces of texts: as many of each kind, and as many clean ones.
SAMPLE_DOCS = 400
WINDOW, STRIDE = 96, 48
EMBED, HIDDEN, TAGS = 8, 12, 1 + 2 * len(KINDS)
EPOCHS, BATCH, RATE = 14, 48, 0.02
#: Least probability, at each character, of the tag that a new span gives it.
SURE = 0.9
_SEED = re.compile(r"[0-9@]")
_MARKS = "@.+-()_% \n\t:,/=[]#*"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


# ---- patterns -------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the local part is what can stand before it, back to the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, in that order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the tagger -----------------------------------------------------------------------------

def symbols(text: str) -> np.ndarray:
    """Characters as small numbers: 0 outside, letters by case, digits, marks, others."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(1)
        elif c in _MARKS:
            out.append(5 + _MARKS.index(c))
        else:
            out.append(2 if c.islower() else 3 if c.isupper() else 4)
    return np.array(out, np.int64)


SYMBOLS = 5 + len(_MARKS)


def windows_of(text: str) -> list[int]:
    """Starts of overlapping windows that together hold every place a span can be: those with a digit
    or an @, without which no kind of span exists, and their neighbours."""
    starts = set()
    for m in _SEED.finditer(text):
        k = m.start() // STRIDE
        starts.update((k - 1, k))
    return [k * STRIDE for k in sorted(starts)]


def _window(sym: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    a, b = max(start, 0), min(start + WINDOW, len(sym))
    out[a - start:b - start] = sym[a:b]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, an LSTM in each direction, scores of tags, and CRF transitions between tags."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.p = {"e": scale(SYMBOLS, EMBED) * 2, "o": scale(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS),
                  "t": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p["w" + d] = scale(EMBED + HIDDEN, 4 * HIDDEN)
            self.p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c, out, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((n, steps, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            both = np.concatenate([x[:, t], h], axis=1)
            z = both @ self.p["w" + d] + self.p["b" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            kept.append((t, both, i, f, o, g, before, c))
        return out, kept

    def _lstm_back(self, dout: np.ndarray, kept: list, d: str, grads: dict, dx: np.ndarray) -> None:
        dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        for t, both, i, f, o, g, before, c in reversed(kept):
            dh = dh + dout[:, t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc ** 2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                 dc * i * (1 - g ** 2)], axis=1)
            grads["w" + d] += both.T @ dz
            grads["b" + d] += dz.sum(0)
            back = dz @ self.p["w" + d].T
            dx[:, t] += back[:, :EMBED]
            dh, dc = back[:, EMBED:], dc * f

    def emit(self, sym: np.ndarray) -> tuple:
        x = self.p["e"][sym]
        forth, kept_f = self._lstm(x, "f")
        back, kept_b = self._lstm(x, "b")
        h = np.concatenate([forth, back], axis=2)
        return h @ self.p["o"] + self.p["ob"], h, kept_f, kept_b

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums and the log normaliser."""
        t, (n, steps, _) = self.p["t"], s.shape
        a, b = np.empty_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for k in range(1, steps):
            a[:, k] = s[:, k] + _log_sum(a[:, k - 1][:, :, None] + t, 1)
        for k in range(steps - 2, -1, -1):
            b[:, k] = _log_sum(t[None] + (s[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        return a, b, _log_sum(a[:, -1], 1)

    def step(self, sym: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags, and its gradients."""
        s, h, kept_f, kept_b = self.emit(sym)
        a, b, z = self.marginals(s)
        n, steps, _ = s.shape
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        ds = np.exp(a + b - z[:, None, None])
        gold = s[rows, cols, tags].sum() + self.p["t"][tags[:, :-1], tags[:, 1:]].sum()
        ds[rows, cols, tags] -= 1
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        for k in range(1, steps):
            joint = a[:, k - 1][:, :, None] + self.p["t"][None] + (s[:, k] + b[:, k])[:, None, :] - z[:, None, None]
            grads["t"] += np.exp(joint).sum(0)
        np.add.at(grads["t"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        grads["o"] += np.einsum("nth,ntk->hk", h, ds)
        grads["ob"] += ds.sum((0, 1))
        dh = ds @ self.p["o"].T
        dx = np.zeros((n, steps, EMBED))
        self._lstm_back(dh[:, :, :HIDDEN], kept_f, "f", grads, dx)
        self._lstm_back(dh[:, :, HIDDEN:], kept_b, "b", grads, dx)
        np.add.at(grads["e"], sym, dx)
        return float(z.sum() - gold) / n, {k: v / n for k, v in grads.items()}

    def fit(self, sym: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        """Adam over shuffled batches; returns the loss of each epoch."""
        rng, losses, turn = np.random.default_rng(1), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order, total = rng.permutation(len(sym)), 0.0
            for k in range(0, len(order), BATCH):
                at = order[k:k + BATCH]
                loss, grads = self.step(sym[at], tags[at])
                total, turn = total + loss * len(at), turn + 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= RATE * (m[name] / (1 - 0.9 ** turn)) / (np.sqrt(v[name] / (1 - 0.99 ** turn)) + 1e-8)
            losses.append(total / len(sym))
        return losses

    def decode(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequences and the probability of each of their tags."""
        s = self.emit(sym)[0]
        a, b, z = self.marginals(s)
        n, steps, _ = s.shape
        best, back = s[:, 0], np.empty((n, steps, TAGS), np.int64)
        for k in range(1, steps):
            paths = best[:, :, None] + self.p["t"]
            back[:, k] = paths.argmax(1)
            best = paths.max(1) + s[:, k]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for k in range(steps - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        chance = np.exp(a + b - z[:, None, None])
        return tags, np.take_along_axis(chance, tags[:, :, None], 2)[:, :, 0]


def _respelled(kind: int, part: str, turn: int) -> str:
    """A span written as its pattern doesn't expect it."""
    if kind == 0:
        return part.replace("@", ("[@]", "(@)")[turn % 2]) if turn % 3 else part.replace(".", "[.]")
    if kind == 1:
        return part.replace(".", ("[.]", ",", " . ")[turn % 3])
    if kind == 2:
        digits = re.sub("[^0-9]", "", part)
        return "._"[turn % 2].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return part[1:] if turn % 2 else re.sub("[^0-9]+", "/", part[1:])


def labelled(texts: list[str], known: list[list[tuple[int, int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from texts and their spans; and again with spans of all kinds written as patterns
    don't expect them (see `_respelled`): + and all else alike."""
    sym, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]]):
        tag = np.zeros(len(text), np.int64)
        for s, kind, e in spans:
            tag[s:e] = 2 + 2 * kind
            tag[s] = 1 + 2 * kind
        all_sym = symbols(text)
        for start in windows_of(text):
            sym.append(_window(all_sym, start))
            tags.append(_window(tag, start))

    turns = [0] * len(KINDS)
    for text, spans in zip(texts, map(base_spans, texts) if known is None else known, strict=True):
        add(text, spans)
        out, changed, last = "", [], 0
        for s, kind, e in spans:
            if s < last:
                continue
            part = _respelled(kind, text[s:e], turns[kind])
            turns[kind] += 1
            out += text[last:s]
            changed.append((len(out), kind, len(out) + len(part)))
            out += part
            last = e
        if changed:
            add(out + text[last:], changed)
    return np.array(sym, np.int64).reshape(-1, WINDOW), np.array(tags, np.int64).reshape(-1, WINDOW)


def pieces(text: str) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(kind, piece of the text around a span, spans in it); of a text without spans, one around a digit
    or an @, of kind len(KINDS)."""
    spans = base_spans(text)
    for s, kind, e in spans:
        a, b = max(s - WINDOW, 0), min(e + WINDOW, s + 4 * WINDOW, len(text))
        a = max([a, *(x[2] for x in spans if x[0] < a < x[2] <= s)])
        yield kind, text[a:b], [(x[0] - a, x[1], min(x[2], b) - a) for x in spans if a <= x[0] < b]
    if not spans and (m := _SEED.search(text)):
        yield len(KINDS), text[max(m.start() - WINDOW, 0):m.end() + WINDOW], []


def _plausible(kind: int, part: str) -> bool:
    """What a span of a kind holds at least, however it is written."""
    digits = sum(c.isdigit() and c.isascii() for c in part)
    if kind == 0:
        return re.search(r"[^@\s]+@[^@\s]+", part) is not None
    if kind == 1:
        return len(re.findall("[0-9]+", part)) == 4 and all(int(x) <= 255 for x in re.findall("[0-9]{1,9}", part))
    if kind == 2:
        return 12 <= digits <= 19 and luhn(re.sub("[^0-9]", "", part))
    return 9 <= digits <= 15 and len(re.findall("[0-9]+", part)) >= 3


def added_spans(tagger: Tagger, texts: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger finds beside the known ones.

    Windows overlap; each character has the tag of the window in which it lies most central, and
    spans are read from the tags of the whole text. A new span stays if all its tags are sure,
    it is plausible and no known span touches it.
    """
    where, syms = [], []
    for i, text in enumerate(texts):
        starts = windows_of(text)
        if starts:
            sym = symbols(text)
            where += [(i, s) for s in starts]
            syms += [_window(sym, s) for s in starts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not where:
        return out
    tags, chance = (np.concatenate(x) for x in zip(*(tagger.decode(np.array(syms[k:k + 512])) for k in range(0, len(syms), 512)), strict=True))
    by_text: dict[int, list[int]] = {}
    for j, (i, _) in enumerate(where):
        by_text.setdefault(i, []).append(j)
    quarter = (WINDOW - STRIDE) // 2
    for i, rows in by_text.items():
        text = texts[i]
        tag, sure = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1)
        covered = {where[j][1] for j in rows}
        for j in rows:
            s = where[j][1]
            a = s + (quarter if s - STRIDE in covered else 0)
            b = s + WINDOW - (quarter if s + STRIDE in covered else 0)
            a, b = max(a, 0), min(b, len(text))
            if a < b:
                tag[a:b], sure[a:b] = tags[j, a - s:b - s], chance[j, a - s:b - s]
        edges = np.flatnonzero(np.diff(tag > 0, prepend=False))
        for s, e in zip(edges[::2], edges[1::2], strict=False):
            kinds = (tag[s:e] - 1) // 2
            kind = int(np.bincount(kinds).argmax())
            part = text[s:e]
            if ((kinds == kind).all() and sure[s:e].min() >= SURE and _plausible(kind, part)
                    and not any(x[0] < e + 1 and s < x[2] + 1 for x in known[i])):
                out[i].append((int(s), kind, int(e)))
    return out


# ---- the operator ---------------------------------------------------------------------------

def sampled(docs: DataFrame, text: str, each: int) -> DataFrame:
    """(kind, h, piece, spans): of each kind the `each` first distinct pieces by hash, over all documents.

    Each task keeps no more than those of its own; texts of any length are looked through whole.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in range(len(KINDS) + 1)]

        def shrink(own: dict) -> dict:
            return dict(sorted(own.items())[:each])

        for b in rows:
            for t in b.column("t").to_pylist():
                for kind, piece, spans in pieces(t):
                    h = hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    kept[kind][int.from_bytes(h, "big", signed=True)] = (piece, [x for s in spans for x in s])
                    if len(kept[kind]) > 8 * each:
                        kept[kind] = shrink(kept[kind])
        found = [(k, h, *x) for k, own in enumerate(kept) for h, x in shrink(own).items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())))],
            names=["kind", "h", "piece", "spans"])

    found = stored(docs.select(text_or_empty(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
                   .mapInArrow(run, "kind int, h long, piece string, spans array<int>"), "pieces")
    parts = [found.where(F.col("kind") == k).dropDuplicates(["h"]).orderBy("h").limit(each) for k in range(len(KINDS) + 1)]
    return reduce(DataFrame.unionByName, parts)


def fit_tagger(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS) -> Tagger | None:
    """A tagger fitted on at most `sample` pieces of texts: the first by hash around spans of each kind,
    and of texts with an @ or a digit but no span. None if no text holds a span."""
    some = sorted(sampled(docs, text, max(sample // (len(KINDS) + 1), 1)).collect(), key=lambda r: (r.kind, r.h))
    sym, tags = labelled([r.piece for r in some], [list(zip(*[iter(r.spans)] * 3, strict=True)) for r in some])
    if not (tags > 0).any():
        return None
    tagger = Tagger()
    tagger.fit(sym, tags)
    return tagger


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


@apart("text")
def find_private(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """The columns of `docs` but the text, with _base and _spans (kind:start:end, comma-joined, code
    points) and _email, _ip, _card, _phone: how many base spans of each kind.

    The patterns' spans always stay; the tagger adds what they miss. Null texts are empty. Rows
    are independent: no shuffle, and equal rows get equal results. Without labelled spans to fit
    on in any text there is no tagger and the base spans are all.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit_tagger(docs, text))
    names = [c for c in docs.columns if c != text]
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [t or "" for t in part.column(text).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(model.value, texts, base) if model.value else [[] for _ in texts]
                counts = [[sum(x[1] == kind for x in s) for s in base] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(map(_told, base), pa.string()),
                     pa.array([_told(s + m) for s, m in zip(base, more, strict=True)], pa.string()),
                     *[pa.array(c, pa.int64()) for c in counts]],
                    names=[*names, "_base", "_spans", *[f"_{k}" for k in KINDS]])

    return docs.mapInArrow(run, own + "_base string, _spans string, " + ", ".join(f"_{k} long" for k in KINDS))



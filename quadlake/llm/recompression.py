"""Substring dedup by recompression: rounds that name runs and pairs of words alike everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quadlake.llm.common import _powers, apart, mix, range_hashes, word_hashes
from quadlake.llm.repeats import Runs, by_window, covered, repeated_spans, without_spans

WINDOW = 20
ROUNDS = 4
#: Windows go on only if the symbols at their inner boundaries of this round occur more than once.
CHECK = 2
FAR = 1 << 40
MARK = np.uint64(0x5D588B656C078965)


def rounds(words: np.ndarray, n_rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """Per round the boundaries left: place, first and last place each depends on, and key.

    A boundary between two symbols goes if they are equal (a run) or if the round's coin says
    left for the first and right for the second (a pair); what lies between boundaries gets a
    name that is a hash of what it is made of. So names need no table and are the same in every
    task, and whether a boundary stays depends on its two symbols alone: equal substrings keep
    the same boundaries inside, but for a few symbols at their ends.
    """
    out = []
    sym, place = words, np.arange(len(words) + 1)
    lo = hi = place
    for r in range(n_rounds):
        if len(sym) < 2:
            break
        coin = mix(sym + np.uint64(r + 1)) & np.uint64(1)
        left, right = sym[:-1], sym[1:]
        stays = ~((left == right) | ((coin[:-1] == 0) & (coin[1:] == 1)))
        at = np.flatnonzero(stays) + 1
        depends_lo, depends_hi = lo[at - 1], hi[at + 1]
        key = mix(left[at - 1] * np.uint64(0x9E3779B97F4A7C15) + right[at - 1] + np.uint64(r))
        out.append((place[at], depends_lo, depends_hi, key))
        begins = np.concatenate([[0], at])
        inside = np.arange(len(sym)) - np.repeat(begins, np.diff(np.append(begins, len(sym))))
        power = _powers(len(sym))[0]
        sym = mix(np.add.reduceat(mix(sym) * power[inside], begins) + np.uint64(r))
        place = np.concatenate([[0], place[at], place[-1:]])
        lo = np.concatenate([[-FAR], depends_lo, place[-1:]])
        hi = np.concatenate([[0], depends_hi, [FAR]])
    return out


def _windows(texts: list[bytes]):
    """Words of all texts, a mark after each text; starts of the texts; starts of windows inside texts."""
    h, starts, _ = word_hashes(b"\n".join(texts))
    at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    begins = at + np.arange(len(at))
    words = np.full(len(h) + len(texts), MARK)
    words[np.arange(len(h)) + np.repeat(np.arange(len(texts)), np.diff(at))] = h
    ends = np.repeat(begins[1:] - 1, np.diff(begins))
    return words, begins, np.flatnonzero(np.arange(len(words)) + WINDOW <= ends)


def anchored(words: np.ndarray, windows: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of each window's anchor.

    A window's anchor is the first boundary of the highest round that depends on nothing outside
    it: the symbols next to it are those of every equal window. A window without one (all words
    alike) has its first words as anchor.
    """
    owner = np.full(len(windows), -1, np.int64)
    key = np.zeros(len(windows), np.uint64)
    for level, (place, lo, hi, names) in reversed(list(enumerate(levels))):
        free = np.flatnonzero(owner < 0)
        if not len(free) or not len(place):
            continue
        at = np.searchsorted(lo, windows[free])
        inside = at < len(place)
        inside[inside] = hi[at[inside]] <= windows[free[inside]] + WINDOW
        owner[free[inside]] = place[at[inside]] * (ROUNDS + 1) + level
        key[free[inside]] = names[at[inside]]
    alone = np.flatnonzero(owner < 0)
    first = windows[alone]
    owner[alone] = -2 - first
    key[alone] = mix(words[first] * np.uint64(31) + words[first + 1] * np.uint64(17) + words[first + 2])
    return owner, key


def _inside(windows: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries of round CHECK, from and to, that depend on nothing outside each window."""
    if len(levels) <= CHECK:
        return np.zeros(len(windows), int), np.zeros(len(windows), int)
    _, lo, hi, _ = levels[CHECK]
    a = np.searchsorted(lo, windows)
    return a, np.maximum(a, np.searchsorted(hi, windows + WINDOW, "right"))


def keys(texts: list[bytes]) -> np.ndarray:
    """The symbols next to all boundaries of round CHECK, and anchors of windows without one."""
    words, _, windows = _windows(texts)
    levels = rounds(words)
    a, b = _inside(windows, levels)
    bare = windows[a == b]
    owner, key = anchored(words, bare, levels)
    new = np.diff(owner, prepend=-1) != 0
    return np.concatenate([levels[CHECK][3], key[new]]) if len(levels) > CHECK else key[new]


def found(texts: list[bytes], shared) -> Runs | None:
    """Runs of windows with one anchor whose inner boundaries all have symbols found elsewhere too."""
    words, begins, windows = _windows(texts)
    if not len(windows):
        return None
    levels = rounds(words)
    a, b = _inside(windows, levels)
    odd = np.zeros(1, int)
    if len(levels) > CHECK:
        odd = np.concatenate([odd, np.cumsum(~shared(levels[CHECK][3]))])
    some = np.flatnonzero(odd[b] - odd[a] == 0)
    windows, bare = windows[some], (a == b)[some]
    owner, key = anchored(words, windows, levels)
    if bare.any():
        keep = ~bare
        keep[bare] = shared(key[bare])
        windows, owner, key = windows[keep], owner[keep], key[keep]
    if not len(windows):
        return None
    names = _window_names(words)
    new = np.flatnonzero((np.diff(owner, prepend=owner[0] - 1) != 0) | (np.diff(windows, prepend=-2) != 1))
    first, count = windows[new], np.diff(np.append(new, len(windows)))
    text = np.searchsorted(begins, first, "right") - 1
    return Runs(text, key[new], first - begins[text], count, range_hashes(words, first, first + count + WINDOW - 1),
                lambda i: names[first[i]:first[i] + count[i]].tobytes())


def _window_names(words: np.ndarray) -> np.ndarray:
    """128-bit hashes of all windows."""
    power, inverse = _powers(len(words))
    n = len(words) - WINDOW + 1
    out = np.empty((n, 2), np.uint64)
    for j, w in enumerate((words, mix(words))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:len(w)], dtype=np.uint64)])
        out[:, j] = mix((sums[WINDOW:] - sums[:-WINDOW]) * inverse[:n])
    return out


def _cut(text: str, spans: np.ndarray | None) -> tuple[str, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    if spans is None:
        return b" ".join(words).decode("utf-8", "surrogatepass"), len(words), 0
    gone = covered(spans, len(words))
    left = [w for w, x in zip(words, gone, strict=True) if not x]
    return b" ".join(left).decode("utf-8", "surrogatepass"), len(words), int(gone.sum())


@apart("doc_id", "text")
def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the words of `text` left over, joined by blanks, and _n_words, _n_removed.

    A word goes if a window of WINDOW words that covers it also starts earlier: in a document
    with a smaller id, or before it in the same one. Windows are judged on the input. Null texts
    are empty; null ids come last, as one document; equal rows are the same document and keep
    what one of them keeps. Words are compared by 64-bit, windows by 128-bit hashes.
    """
    spans = repeated_spans(docs, keys, found, lambda told: by_window(told, 16, 16), WINDOW, True, doc_id, text)
    return without_spans(docs, spans, _cut, "_n_words long, _n_removed long", doc_id, text)

"""Cutting against the tokenizer's library, packing against its lower bound and an exact search."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadlake.llm import packing
from tests.llm.cases import documents, frame, saved

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's 'store' --'s \x1cx\x1d y", "ΣΑΣ ΟΔΟΣ. Σ", "a<|endoftext|>b <|ENDOFTEXT|> c", "\x01 \x01.x", "été, İstanbul!",
       "7 77 x7y. word, word. word", "́ a b c", "x" * 3000 + ".", "....,,, !?", "ﬁ Ǆ ẞ", "힣 한"]


def test_ids_are_those_of_the_library():
    own = packing.Encoder(open(PATH, encoding="utf-8").read())
    plain = Tokenizer.from_file(PATH)
    texts = ODD + [t or "" for _, t, *_ in documents()]
    for _ in range(2):  # the second time from memory
        got = own.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    own = packing.Encoder(open(PATH, encoding="utf-8").read())
    plain = Tokenizer.from_file(PATH)
    for t in [t or "" for _, t, *_ in documents()][:40] * 2:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def check_places(rows, capacity):
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_returns_every_piece_once(spark, tmp_path):
    from quadlake.llm.queries import QUERIES

    rows = documents() + [(900 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    got = QUERIES["op12_best_fit_packing"](spark, saved(spark, tmp_path, rows)).collect()
    plain, want = Tokenizer.from_file(PATH), []
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc_id, k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()))
                 for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = check_places([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert used == -(-sum(w[3] for w in want) // 4096)


def test_pieces_carry_their_ids_and_columns(spark):
    rows = frame(spark, documents()).withColumnRenamed("lang", "_text").withColumnRenamed("source", "piece")
    got = packing.cut(rows, PATH, capacity=100)
    assert got.columns == ["doc_id", "text", "_text", "n_chars", "piece", "start", "length", "ids_crc32", "ids"]
    for r in got.limit(500).collect():
        assert len(r.ids) == r.length <= 100 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.cut(rows.limit(0), PATH).count() == 0


def fewest(lengths, capacity):
    for n in range(1, len(lengths) + 1):
        for where in itertools.product(range(n), repeat=len(lengths)):
            if all(sum(x for x, w in zip(lengths, where) if w == b) <= capacity for b in range(n)):
                return n


def test_exchanges_empty_what_best_fit_leaves():
    for seed in range(150):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 12) for _ in range(7)]
        first, best = packing.best_fit(lengths, 16), fewest(lengths, 16)
        got = packing.packed(lengths, 16)
        assert sorted(i for b in got for i in b) == list(range(7))
        assert all(sum(lengths[i] for i in b) <= 16 for b in got)
        assert best <= len(got) <= len(first)
    better = 0
    for seed in range(40):
        rng = random.Random(seed)
        lengths = [rng.randint(20, 45) for _ in range(60)]
        better += len(packing.packed(lengths, 100)) < len(packing.best_fit(lengths, 100))
    assert better > 10
    rng = random.Random(3)
    hard = [rng.choice([30, 31, 34, 36, 39, 41]) for _ in range(300)]
    assert len(packing.packed(hard, 100)) <= len(packing.best_fit(hard, 100))
    squares = lambda bins: sum(sum(hard[i] for i in b) ** 2 for b in bins)
    assert squares(packing.packed(hard, 100)) >= squares(packing.best_fit(hard, 100))


@pytest.mark.parametrize("kind", ["mixed", "large", "equal"])
def test_rounds_over_many_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = random.Random(1)
    low, high = {"mixed": (1, 200), "large": (60, 90), "equal": (7, 7)}[kind]
    sizes = [rng.randint(low, high) for _ in range(1200)] + [100, 100, 250, 0, None]
    rows = spark.createDataFrame([(i, s, "a", 5) for i, s in enumerate(sizes)], "id long, length int, sequence_id string, _uid int")
    got = packing.pack(rows, capacity=100).collect()
    assert len(got) == len(sizes) and got[0]._uid == 5
    small = [s for s in sizes if s and s <= 100]
    used = check_places([(r.sequence_id, r.offset, r.length or 0) for r in got if (r.length or 0) <= 100], 100)
    if kind == "large":
        assert used <= sum(s > 50 for s in small) + 1
    else:
        over = sum(s > 50 for s in small)
        assert used <= max(over + 2, 1.07 * -(-sum(small) // 100) + 2)


def test_nothing_to_pack(spark):
    rows = spark.createDataFrame([], "id long, length int")
    assert packing.pack(rows).collect() == []

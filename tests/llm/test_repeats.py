import hashlib
import random

import numpy as np
import pytest

from quadlake.llm import recompression, suffixes
from quadlake.llm.common import KeyFilter
from quadlake.llm.queries import QUERIES
from tests.llm.cases import documents, saved

ROWS = [*documents(n=70), (500, "x" * 400, None, None, 0), (501, "ab" * 300 + "x" * 80, None, None, 0),
        (502, "same " * 90, None, None, 0), (503, "one same " * 40 + "same " * 30, None, None, 0), (None, "x" * 60, None, None, 0)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_bytes(rows, length=50):
    first = {}
    data = [(NO if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for o, d in data:
        for i in range(len(d) - length + 1):
            w = d[i:i + length]
            first[w] = min(first.get(w, o), o)
    out = []
    for (doc_id, *_), (o, d) in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if first[d[i:i + length]] < o:
                gone[i:i + length] = True
        runs = np.count_nonzero(np.diff(gone, prepend=False, append=False)) // 2
        out.append((doc_id, len(d), int(gone.sum()), runs, sha(bytes(np.frombuffer(d, np.uint8)[~gone]))))
    return sorted(out, key=repr)


NO = (1 << 63) - 1


def brute_words(rows, width=20):
    first = {}
    data = [(NO if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    for o, ws in data:
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i:i + width])
            first[w] = min(first.get(w, (o, i)), (o, i))
    out = []
    for (doc_id, *_), (o, ws) in zip(rows, data, strict=True):
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i:i + width])] < (o, i):
                gone[i:i + width] = True
        out.append((doc_id, len(ws), int(gone.sum()), sha(b" ".join(w for w, x in zip(ws, gone, strict=True) if not x))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [suffixes.MOST_RUNS, 3])
def test_bytes(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_RUNS", most)
    got = QUERIES["op6_suffix_dedup"](spark, saved(spark, tmp_path, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(ROWS)


def test_words(spark, tmp_path):
    got = QUERIES["op7_recompression_dedup"](spark, saved(spark, tmp_path, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(ROWS)


def test_what_a_full_filter_lets_pass_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyFilter, "of", classmethod(lambda cls, keys, col: cls(np.full(cls.bits // 64, ~np.uint64(0)))))
    folder = saved(spark, tmp_path, ROWS)
    got = QUERIES["op7_recompression_dedup"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(ROWS)
    got = QUERIES["op6_suffix_dedup"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(ROWS)


def test_empty_table(spark, tmp_path):
    folder = saved(spark, tmp_path, [])
    assert QUERIES["op6_suffix_dedup"](spark, folder).count() == 0
    assert QUERIES["op7_recompression_dedup"](spark, folder).count() == 0


def test_suffix_order():
    rng = random.Random(2)
    for n, letters in ((1, 2), (2, 1), (50, 1), (300, 2), (400, 3), (500, 200)):
        chars = np.array([rng.randrange(letters) + 1 for _ in range(n)] + [0], np.uint8)
        got = suffixes.suffix_order(chars, 60).tolist()
        data = chars.tobytes()
        assert sorted(got) == list(range(n + 1))
        heads = [data[i:i + 60] for i in got]
        assert heads == sorted(heads)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    words = np.array([rng.randrange(1, 40) for _ in range(4000)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[1000:1100] = words[200:300]
    words[2000:2050] = words[5]
    words[3000:3060] = words[230:290]
    windows = np.arange(len(words) - 19)
    owner, key = recompression.anchored(words, windows, recompression.rounds(words))
    of = {}
    for i, k in zip(windows, key.tolist(), strict=True):
        assert of.setdefault(words[i:i + 20].tobytes(), k) == k
    assert len(set(owner.tolist())) < 0.5 * len(words)


def test_contents_move_once_where_no_anchor_has_very_many_runs(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(k, k * 7 + i, i, 0, rng.randbytes(200)) for k in range(400) for i in range(4)]
    spark.createDataFrame(rows, "k long, c long, o long, a int, content binary").write.parquet(f"{tmp_path}/told")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        solved = suffixes._solve(spark.read.parquet(f"{tmp_path}/told"))
        plan = solved._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "SortMergeJoin [k" not in plan
        assert solved.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

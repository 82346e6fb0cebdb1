import re

import pytest
from pyspark.sql import functions as F

from quadlake.llm import mixing
from quadlake.llm.queries import QUERIES
from tests.llm.cases import documents, frame, saved


def expected_targets(sizes: dict) -> dict:
    """The rule as it is told: share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, over = sum(weight[s] for s in open_), set()
        share = {s: target[s] + left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        left = sum(share[s] - 2 * sizes[s] for s in over)
        target.update({s: min(share[s], 2 * sizes[s]) for s in open_})
        open_ -= over
    return target


def test_query(spark, tmp_path):
    rows = documents()
    folder = saved(spark, tmp_path, rows)
    got = QUERIES["op8_mix_sources"](spark, folder).collect()
    words = {}
    for doc_id, text, _, source, _ in rows:
        words.setdefault(source, []).append((doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    sizes = {s: sum(n for _, n in v) for s, v in words.items()}
    target = expected_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted(x for v in words.values() for x in v)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        taken = sum(r.taken for r in got if source_of[r.doc_id] == s)
        assert abs(taken - target[s]) <= 2
    again = QUERIES["op8_mix_sources"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 3}, {"a": 0, "b": 7}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 900}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(int(s is None), s or "", n) for s, n in sizes.items()], "_none int, _name string, _size long")
    got = {None if r._none else r._name: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(expected_targets(sizes))


def test_no_python_and_rows_of_the_mix(spark):
    df = frame(spark, documents())
    plan = mixing.mixed_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    per = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(v for k, v in per.items() if k != 20) <= 2
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    assert mixing.mix(df.limit(0)).agg(F.sum("taken")).first()[0] is None


def test_many_sources_are_dealt_and_take_the_same(spark, monkeypatch):
    df = frame(spark, documents())
    few = sorted(map(str, mixing.mix(df).select("doc_id", "_size", "taken").collect()))
    plan = mixing.mixed_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(df).select("doc_id", "_size", "taken").collect())) == few

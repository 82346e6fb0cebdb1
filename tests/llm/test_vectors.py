import numpy as np
import pytest

from quadlake.llm import vectors

NAN = float("nan")


def brute(rows):
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows)
          if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {k: [j for j, w in ok if j != k and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9] for k, v in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in link.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((i, len(link.get(k, [])), least, least == i))
    return sorted(out)


@pytest.mark.parametrize("block", [vectors.BLOCK, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i % 40] + 0.12 * rng.standard_normal(24) * (i % 5)).tolist()) for i in range(300)]
    rows += [(400 + i, (base[0] + 0.1 * rng.standard_normal(24)).tolist()) for i in range(90)]
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [NAN] * 24), (604, [None] + [1.0] * 23), (605, [1.0, 2.0]),
             (606, [2.0, 4.0]), (607, base[1].tolist()), (608, base[1].tolist()), (609, (7 * base[1]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty_and_extra_columns(spark):
    schema = "vec_id long, embedding array<float>, id string, m int, kept string"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    row = vectors.near_vectors(spark.createDataFrame([(5, [1.0, 0.0], "x", 3, "y")], schema)).first()
    assert (row.id, row.m, row.n_links, row.component_id, row.kept) == ("x", 3, 0, 5, True)


def test_estimates_are_unbiased_and_bounded():
    unit = np.random.default_rng(2).standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    guess, bound = vectors.estimates(unit)
    off = guess - unit @ unit.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.003 and (np.abs(off) <= bound).all()

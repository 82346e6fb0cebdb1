import hashlib
from collections import Counter

from quadlake.llm import lines
from quadlake.llm.queries import QUERIES
from tests.llm.cases import documents, frame, saved

BLANK = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    keys = [[line.strip(BLANK).translate(LOWER) for line in (t or "").split("\n")] for _, t, *_ in rows]
    seen = Counter(k for own in keys for k in set(own))
    out = []
    for (doc_id, text, *_), own in zip(rows, keys, strict=True):
        left = [line for line, k in zip((text or "").split("\n"), own, strict=True) if not (k and seen[k] >= least)]
        out.append((doc_id, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def test_query(spark, tmp_path):
    rows = documents()
    got = QUERIES["op9_line_dedup"](spark, saved(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert sum(r.n_dropped for r in got) > 20


def test_runs_count_over_batches(spark):
    runs = lines.LineRuns(min_docs=5, fan_in=2)
    total = Counter()
    for i in range(7):
        batch = {h: h % 3 + 1 for h in range(i, i + 12)}
        before = runs.settled and {r.h for r in runs.settled.collect()}
        runs.add(spark.createDataFrame(list(batch.items()), "h long, n long"))
        total.update(batch)
        if before:
            assert before <= {r.h for r in runs.settled.collect()}
    assert {r.h for r in runs.finish().collect()} == {h for h, n in total.items() if n >= 5}


def test_columns_and_empty_table(spark):
    df = frame(spark, documents())
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    assert out.where("doc_id = 0").first().text is None
    named = spark.createDataFrame([("x", "a\nb", 3)], "drop string, text string, key int")
    assert lines.dedup_lines(named).first().asDict() == {"drop": "x", "text": "a\nb", "key": 3, "_n_lines": 2, "_n_dropped": 0}

import duckdb

from quadlake.llm import quality
from quadlake.llm.queries import ORACLES, QUERIES
from tests.llm.cases import documents, frame, saved


def test_query_matches_sql(spark, tmp_path):
    folder = saved(spark, tmp_path, documents(n=400))
    got = QUERIES["op10_quality_rules"](spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op10_quality_rules"]).df()
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_measures():
    assert quality.measure("") == (0, 0, 0, 0, 0, 0)
    assert quality.measure("é b é b é\n x# \n x# \n")[:2] == (7, 9)
    assert quality.measure("a b c a b c")[4] == 6 and quality.measure("a b c d")[4] == 0
    assert quality.measure("a\n a\na\n\n\n")[3] == 1


def test_buckets_are_close_and_merge(spark):
    from pyspark.sql import functions as F
    rows = spark.range(0, 20000, 7).select(F.col("id"), quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id <= r.b * (1 + 1 / 64) for r in rows) and all(r.b == r.id for r in rows if r.id < 128)


def test_junk_goes_and_clean_stays(spark):
    good = [(i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(80)), "en", "s", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{(i * 17 + j * j) % 991}###" for j in range(80)), "en", "s", 0) for i in range(20)]
    df = frame(spark, good + junk)
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in good}
    assert quality.keep_documents(frame(spark, [])).count() == 0

"""Work per row is dealt over all tasks of the session, and done once."""

import os
from collections import Counter

import __spark_entry__ as entry
from quadlake.plans import catalogue
from quadlake.sources import feeds, sinks

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listings_are_parsed_once(spark):
    raw = spark.createDataFrame([(1, "<r><course_list><school school_name='A'/></course_list></r>"), (2, "<r><cou"), (3, None)], "k int, d string")
    tables = feeds.parse_xml_listing(raw, "d", ["k"], once=True)
    assert all("from_xml" not in _plan(table) for table in tables.values())
    assert "from_xml" not in _plan(entry.queries()["xml_listing_explode"](spark, FOLDER))
    assert [tuple(r) for r in tables["school"].select("k", "school").collect()] == [(1, "A")]
    assert sorted((r.k, r.d) for r in tables["rejected"].collect()) == [(2, "<r><cou"), (3, None)]


def test_rule_documents_are_walked_by_many_tasks(spark):
    nodes = entry.queries()["rule_tree_flatten"](spark, FOLDER)
    files = Counter(os.path.dirname(path) for path in nodes.inputFiles())
    assert files and min(files.values()) > 1


def test_requirement_texts_are_read_by_many_tasks(spark):
    raw = spark.createDataFrame([(i, "B 1 AND C 2") for i in range(64)], "k int, t string").coalesce(1)
    trees, edges = catalogue.prereq_tables(raw, "k", "t")
    assert trees.rdd.getNumPartitions() == 8
    assert edges.count() == 128


def test_program_pages_are_read_by_as_many_tasks_as_are_asked_for(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i % 97, "1-URGENT" if i % 5 == 0 else "5-LOW", "F", 300000.0 + i) for i in range(2000)],
                          "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    written = []
    keep = sinks.keep
    monkeypatch.setattr(sinks, "keep", lambda df, name: written.append(keep(df, name)) or written[-1])
    out = entry.queries()["grid_to_terms"](spark, str(tmp_path))
    assert len(written[0].inputFiles()) > 4
    assert out.select("o_custkey").distinct().count() == 97

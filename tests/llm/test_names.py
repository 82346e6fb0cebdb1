"""Columns of the caller may be named like those the operators make."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quadlake.llm import bpe, brown, jaccard, lines, mixing, private, quality, recompression, suffixes, vectors
from tests.llm.cases import documents, frame

NAMES = ["_drop", "_m", "_M2", "_n", "_s", "_s0", "_spans", "_base", "_row", "_key", "_size", "_text", "_t1", "_t2", "_none", "_name", "_at",
         "_l", "_kept", "_failed", "_h", "_v", "_root", "_n_lines", "_n_bytes", "_email", "_copy", "_cut", "_salt", "target", "taken",
         "source_size", "component_id", "n_links", "kept", "ids", "held_out", "score", "n_tokens", "k", "n", "g", "h", "count", "batch", "chunk", "given0"]

RANKS = P.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "lines": lines.dedup_lines, "verdicts": lambda d: quality.verdicts(d, carry=["doc_id"]), "quality": quality.keep_documents,
    "groups": jaccard.near_groups, "one": jaccard.one_of_each, "suffixes": suffixes.dedup_bytes,
    "passages": recompression.dedup_passages, "private": private.find_private, "brown": brown.scored,
    "bpe": lambda d: bpe.encode(d, RANKS, P.PATTERN), "mix": mixing.mix, "mixed": mixing.mixed_documents}


def clashing(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


@pytest.mark.parametrize("name", OPERATORS)
def test_made_names_may_clash(spark, name):
    # All columns of the mix make the hash of a row, so more columns may take another part.
    base = frame(spark, documents(n=24))
    plain, full = OPERATORS[name](base), OPERATORS[name](clashing(base))
    assert set(plain.columns) <= set(full.columns) and len(set(full.columns)) == len(full.columns)
    if name not in ("mix", "mixed"):
        assert sorted(map(str, full.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    elif name == "mix":
        sums = [d.agg(F.sum("taken"), F.sum("_size")).first() for d in (plain, full)]
        assert sums[0] == sums[1]
    handed = [n for n in NAMES if n in full.columns and n not in plain.columns]
    assert all(r[n] == f"own {n}" for r in full.collect() for n in handed)
    assert handed or name == "verdicts"


def test_vectors_with_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    made = ["vec_id", "n_links", "component_id", "kept"]
    got = vectors.near_vectors(clashing(df))
    assert sorted(map(tuple, got.select(*made).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert {r._row for r in got.collect()} == {"own _row"}

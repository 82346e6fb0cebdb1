"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import retire, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each id of `edges` (a, b) reaches. Ids outside edges are absent.

    Rounds of contraction: every id hooks onto its smallest smaller neighbour, pointers are doubled
    until they rest, and edges move to what their ends point at. Each step is an aggregation with
    map-side minima or an equi-join that splits a hot id; each round's table is written.
    Null ids and self-links are ignored; an empty table gives an empty result.
    """
    loose = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(loose.distinct(), "edges")
    found = None
    while not current.isEmpty():
        parents = _rest(stored(current.groupBy("a").agg(F.min("b").alias("p")), "parents"))
        ends = (current.join(parents, "a").select(F.col("p").alias("x"), F.col("b").alias("a"))
                .join(parents, "a", "left").select("x", F.coalesce("p", "a").alias("y")).where("x <> y")
                .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
        following = stored(ends.distinct(), "edges")
        retire(current)
        if found is None:
            found = parents
        else:
            later = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
            found = stored(found.join(later, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
                           .unionByName(parents).distinct(), "parents")
        current = following
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    roots = found.select(F.col("p").alias("id"), F.col("p").alias("component")).distinct()
    return found.select(F.col("a").alias("id"), F.col("p").alias("component")).unionByName(roots)


def _rest(parents: DataFrame) -> DataFrame:
    """Double the pointers until they all point at roots."""
    while True:
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
        moved = stored(parents.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"),
                                                            F.col("q").isNotNull().alias("moved")), "parents")
        retire(parents)
        parents = moved.select("a", "p")
        if moved.where("moved").isEmpty():
            return parents

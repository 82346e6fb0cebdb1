"""Near-dedup of embeddings by binary codes of randomly rotated vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import apart, stored
from quadlake.llm.components import components

SIMILAR = 0.9
#: Chance that a pair of exactly that cosine meets in no table of codes.
MISS = 0.002
#: Vectors a bucket is meant to hold, and holds at most before it is cut into blocks.
BUCKET = 64
BLOCK = 2048
#: Standard errors by which an estimate must miss before a pair is not computed exactly.
ERRORS = 5.0
SEED = 11

_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, i: int) -> np.ndarray:
    """The i-th random rotation of the space: the same in every task."""
    if (dim, i) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, i]).standard_normal((dim, dim)))
        _ROTATIONS[dim, i] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, i]


def shape(n: int) -> tuple[int, int]:
    """(bits of a bucket's code, number of tables) for n vectors: buckets keep their size as n grows,
    and the tables' number keeps the chance to miss a pair."""
    bits = max(2, round(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 2
    alike = 1 - math.acos(SIMILAR) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - alike ** bits))


def codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table: signs of rotated coordinates."""
    dim = unit.shape[1]
    per = max(1, dim // bits)
    out = np.empty((len(unit), tables), np.int64)
    for t in range(tables):
        signs, need = [], bits
        turn = t // per if dim >= bits else t * math.ceil(bits / dim)
        start = (t % per) * bits if dim >= bits else 0
        while need > 0:
            z = unit @ rotation(dim, turn)[:, start:start + need]
            signs.append(z > 0)
            need -= z.shape[1]
            turn, start = turn + 1, 0
        out[:, t] = np.concatenate(signs, axis=1) @ (1 << np.arange(bits, dtype=np.int64))
    return out


def estimates(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, bounds): unbiased estimates of all cosines from one side's codes.

    A vector's code is the corner of the rotated cube next to it, and <code, vector> is stored as
    its correction factor: <code, other> / factor is <vector, other> on average, with a standard
    error of sqrt((1 - factor**2) / factor**2 / (dim - 1)).
    """
    dim = unit.shape[1]
    z = unit @ rotation(dim, 0)
    code = np.where(z > 0, 1.0, -1.0) / math.sqrt(dim)
    factor = np.maximum(np.einsum("ij,ij->i", code, z), 1e-12)
    error = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(dim - 1, 1))
    return (code / factor[:, None]) @ z.T, ERRORS * error[:, None]


def _tables(bits: int, tables: int, only_codes: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            by_dim: dict[int, list[int]] = {}
            vectors = b.column("v").to_pylist()
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                unit = np.array([vectors[i] for i in at], float)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                found = codes(unit, bits, tables)
                part = b.take(pa.array(at))
                for t in range(tables):
                    columns = {"dim": np.full(len(at), dim, np.int32), "t": np.full(len(at), t, np.int32), "code": found[:, t]}
                    arrays = [pa.array(x) for x in columns.values()]
                    names = list(columns)
                    if not only_codes:
                        arrays += part.columns
                        names += part.schema.names
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _compare(bits: int, tables: int):
    """Links inside cells: (a, null, n) counts a's partners, (a, b, 0) connects."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(rows):
            out = list(_links(cell, bits, tables))
            if out:
                a, b, n = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=_OUT)

    return run


def _cells(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    cell, last = [], None
    for b in rows:
        for row in zip(*(b.column(c).to_pylist() for c in ("cell", "t", "side", "id", "m", "v")), strict=True):
            if row[0] != last and cell:
                yield cell
                cell = []
            last = row[0]
            cell.append(row)
    if cell:
        yield cell


def _links(cell: list[tuple], bits: int, tables: int) -> Iterator[tuple]:
    if len(cell) < 2:
        return
    t = cell[0][1]
    side = np.array([x[2] for x in cell])
    ids, counts = np.array([x[3] for x in cell]), np.array([x[4] for x in cell])
    vectors = np.array([x[5] for x in cell], float)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    guess, bound = estimates(unit)
    maybe = (guess + bound >= SIMILAR) & (guess.T + bound.T >= SIMILAR)
    if (side == 1).any():  # two blocks of one bucket: only pairs across
        maybe &= side[:, None] < side[None, :]
    i, j = np.nonzero(np.triu(maybe, 1) if not (side == 1).any() else maybe)
    near = np.concatenate([np.einsum("ij,ij->i", unit[i[k:k + 100_000]], unit[j[k:k + 100_000]]) >= SIMILAR
                           for k in range(0, len(i), 100_000)]) if len(i) else np.empty(0, bool)
    i, j = i[near], j[near]
    if t and len(i):  # pairs that met in an earlier table are counted there
        earlier = codes(unit, bits, t)
        for s in range(t):
            fresh = earlier[i, s] != earlier[j, s]
            i, j = i[fresh], j[fresh]
    links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
    for x in np.flatnonzero(links):
        yield int(ids[x]), None, int(links[x])
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield int(ids[x]), int(ids[y]), 0


def usable(col: str) -> Column:
    """Not null, not empty, of finite components, not all zero."""
    v = F.col(col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


@apart("vec_id", "embedding")
def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`table` with n_links, component_id and kept, by cosine SIMILAR or more.

    Equal vectors are one with a multiplicity. In each of some tables every vector goes to the
    bucket of its code's bits, so the work grows little more than the vectors; in a bucket the
    corrected code estimates each cosine, and only pairs whose bound reaches SIMILAR are computed
    in double precision. Links are counted where they meet first and never leave as pairs; only
    as many as connect a bucket's vectors do. A bucket of more than BLOCK vectors is cut into
    blocks and every two blocks are compared, in tasks of their own.

    Unusable vectors (null, empty, zero, null or non-finite components) link with nothing and are
    their own component; vectors of different lengths don't link. Equal ids are separate vectors
    that may link; a null id counts as a vector whose component is the smallest other id, or null.
    """
    rows = stored(table.withColumns({"_v": F.when(usable(embedding), F.col(embedding).cast("array<double>")),
                                     "_row": F.monotonically_increasing_id()}).withColumn("_h", F.xxhash64("_v")), "rows")
    same = rows.where("_v is not null").groupBy("_v").agg(
        F.min("_h").alias("_h"), F.count("*").alias("m"), F.min(vec_id).alias("least"), F.min("_row").alias("id"))
    distinct = stored(same.select("id", "m", "least", F.col("_v").alias("v")), "vectors")
    bits, tables = shape(distinct.count())
    plain = distinct.select("id", "m", "v")
    counts = (plain.select("v").mapInArrow(_tables(bits, tables, True), "dim int, t int, code long")
              .groupBy("dim", "t", "code").count().where("count > 1"))
    sizes = stored(counts.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "buckets")
    dealt = (plain.mapInArrow(_tables(bits, tables, False), "dim int, t int, code long, id long, m long, v array<double>")
             .join(sizes, ["dim", "t", "code"]))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = (dealt.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("dim", "t", "code", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "t",
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "m", "v"))
    met = stored(pairs.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _compare(bits, tables), "a long, b long, n long"), "links")
    links = met.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(met.where("b is not null").select("a", "b"))
    named = (distinct.select("id", "m", "least").join(roots, "id", "left")
             .withColumn("_root", F.coalesce("component", "id")))
    least = named.groupBy("_root").agg(F.min("least").alias("_least"))
    told = (named.join(least, "_root").join(links, "id", "left")
            .select("id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "_least"))
    of_row = rows.where("_v is not null").select("_row", "_v").join(same.select("_v", "id"), "_v").select("_row", "id")
    out = rows.join(of_row.join(told, "id").select("_row", "n_links", "_least"), "_row", "left")
    component = F.coalesce("_least", vec_id)
    return out.select(*[F.col(f"`{c}`") for c in table.columns if c not in ("n_links", "component_id", "kept")],
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.col(vec_id).eqNullSafe(component).alias("kept"))

"""Hard negatives by shared lists: one list of candidates by angular bound for each cluster of anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores between this share (per cent) of the positive's score and the score itself.
NEAREST = 80
#: Anchors the clusters are fitted on at most, clusters at most, and anchors a cluster is meant to hold.
SAMPLE = 8192
CLUSTERS = 256
MEMBERS = 64
#: Anchors and candidates that meet in one task; candidate shares of the first round, and how rounds grow.
BATCH = 1024
SHARE = 8192
GROWTH = 8
#: Candidates a walk looks at in one step.
STEP = 512
#: Relative error allowed for in bounds.
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SEED = 17


# ---- vectors of whole numbers ---------------------------------------------------------------

def _whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: 16-bit numbers where they fit, else 64-bit ones."""
    for b in rows:
        packed = []
        for v in b.column("q").to_pylist():
            q = np.array(v, np.int64)
            packed.append((q.astype("<i2") if not len(q) or np.abs(q).max() < 1 << 15 and q.min() > LEAST else q.astype("<i8")).tobytes())
        dims = pa.array([len(v) for v in b.column("q").to_pylist()], pa.int32())
        keep = ["uid", "id", "label", "anchor"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], dims, pa.array(packed, pa.binary())], names=[*keep, "dim", "q"])


def _matrix(q: list[bytes], dim: int) -> np.ndarray:
    """Rows as float64; exact as long as components stay below 2**53, which `_scores` sees to."""
    out = np.empty((len(q), dim), np.int64)
    for i, x in enumerate(q):
        out[i] = np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<i8")
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, held to the range of a long."""
    x, y = a.astype(float), b.astype(float)
    size = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0) * np.einsum("ij,ij->i", y, y).max(initial=0))
    if size < 1 << 52:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; the zero vector stays zero."""
    x = x.astype(float)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _fit(sample: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Centres of anchors' directions by dimension: a few turns of spherical k-means."""
    out = {}
    for dim, x in sample.items():
        unit, _ = _directions(x)
        k = min(CLUSTERS, -(-len(unit) // MEMBERS))
        centres = unit[np.random.default_rng(SEED).choice(len(unit), k, replace=False)]
        for _ in range(8):
            near = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, unit)
            fine = np.linalg.norm(sums, axis=1) > 0
            centres[fine] = sums[fine] / np.linalg.norm(sums[fine], axis=1, keepdims=True)
        out[dim] = centres
    return out


def _centre(centres: dict[int, np.ndarray], dim: int, cluster: int) -> np.ndarray:
    """A dimension that the sample didn't hold has one cluster around any direction."""
    return centres[dim][cluster] if dim in centres else np.eye(1, dim)[0]


def _assign(centres):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = np.zeros(b.num_rows, np.int32)
            dims = b.column("dim").to_numpy()
            q = b.column("q").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in centres.value:
                    unit, _ = _directions(_matrix([q[i] for i in at], dim))
                    found[at] = (unit @ centres.value[dim].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, "cluster"])

    return run


# ---- the walk -------------------------------------------------------------------------------

def bounds(x: np.ndarray, members: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """For each candidate a number that, times an anchor's length, no member's score with it exceeds: a member
    lies within the cluster's angle of the centre, so its angle to the candidate is at least the difference."""
    unit, norm = _directions(x)
    own, length = _directions(members)
    angles = np.arccos(np.clip(own[length > 0] @ centre, -1, 1))
    to = np.arccos(np.clip(unit @ centre, -1, 1))
    return norm * (np.cos(np.maximum(to - angles.max(initial=0), 0)) + SLACK)


def walk(x: np.ndarray, ids: np.ndarray, allowed, members: np.ndarray, centre: np.ndarray, high: np.ndarray,
         cut: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(member, slot, candidate, score) of the best `most` candidates of each slot of each member, or more.

    A slot takes scores from `cut` to `high`; higher first, ties by smaller id. The candidates are sorted by
    bound once; all members walk that list step by step, and one stops where no bound further on reaches the least of
    what its slots still take. `allowed(members, candidates)` says which pairs count.
    """
    bound = bounds(x, members, centre)
    order = np.argsort(-bound, kind="stable")
    _, length = _directions(members)
    cut = cut.copy()
    best = np.full((*high.shape, most), LEAST, np.int64)
    out: list[tuple] = []
    for at in range(0, len(order), STEP):
        # No member is done while its bound may reach a cut; open cuts are the least long.
        active = np.flatnonzero(length * bound[order[at]] * (1 + SLACK) + 1 >= cut.min(axis=1).astype(float))
        if not len(active):
            break
        some = order[at:at + STEP]
        some = some[np.argsort(ids[some], kind="stable")]
        scores = _scores(members[active], x[some])
        fine = allowed(active, some)
        for slot in range(high.shape[1]):
            hit = fine & (scores >= cut[active, slot, None]) & (scores <= high[active, slot, None])
            rows = np.flatnonzero(hit.any(axis=1))
            if not len(rows):
                continue
            own = np.where(hit[rows], scores[rows], LEAST)
            first = np.argsort(~own, axis=1, kind="stable")[:, :most]  # ~ turns the order around, without overflow
            taken = np.take_along_axis(own, first, axis=1)
            real = np.take_along_axis(hit[rows], first, axis=1)
            who = active[rows]
            grown = np.concatenate([best[who, slot], np.where(real, taken, LEAST)], axis=1)
            best[who, slot] = np.sort(grown, axis=1)[:, -most:]
            cut[who, slot] = np.maximum(cut[who, slot], best[who, slot, 0])
            r, k = np.nonzero(real)
            out.append((who[r], np.full(len(r), slot), some[first[r, k]], taken[r, k]))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    m, slot, c, score = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = np.flatnonzero(score >= cut[m, slot])
    keep = keep[np.lexsort((ids[c[keep]], ~score[keep], slot[keep], m[keep]))]
    group = m[keep] * high.shape[1] + slot[keep]
    start = np.concatenate([[True], group[1:] != group[:-1]]) if len(keep) else np.empty(0, bool)
    place = np.arange(len(keep)) - np.maximum.accumulate(np.where(start, np.arange(len(keep)), 0))
    keep = keep[place < most]
    return m[keep], slot[keep], c[keep], score[keep]


_FOUND = "anchor long, slot int, uid long, id long, score long"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _cell(centres, alike: bool, most: int):
    """All anchors of a batch against a share of the candidates."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [_FOUND_ARROW.empty_table()]
        if not anchors.num_rows or not candidates.num_rows:
            return out[0]
        a = {c: anchors.column(c).to_pylist() for c in ("uid", "label", "dim", "cluster", "q", "high", "cut")}
        plain = {c: candidates.column(c).combine_chunks() for c in ("uid", "id", "label", "dim")}
        c_dim, c_uid, c_label = (plain[c].to_numpy() for c in ("dim", "uid", "label"))
        c_id = plain["id"].fill_null(MOST).to_numpy()
        q = candidates.column("q").to_pylist()
        groups: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(a["dim"], a["cluster"], strict=True)):
            groups.setdefault(key, []).append(i)
        shares: dict[int, tuple] = {}
        for (dim, cluster), own in groups.items():
            if dim not in shares:
                at = np.flatnonzero(c_dim == dim)
                shares[dim] = at, _matrix([q[i] for i in at], dim)
            at, x = shares[dim]
            if not len(at):
                continue
            labels, uids = np.array([a["label"][i] for i in own]), np.array([a["uid"][i] for i in own])

            def allowed(members, some, at=at, labels=labels, uids=uids):
                same = labels[members, None] == c_label[at[some]][None, :]
                return (same if alike else ~same) & (uids[members, None] != c_uid[at[some]][None, :])

            m, slot, c, score = walk(x, c_id[at], allowed, _matrix([a["q"][i] for i in own], dim), _centre(centres.value, dim, cluster),
                                     np.array([a["high"][i] for i in own]), np.array([a["cut"][i] for i in own]), most)
            ids = plain["id"].take(pa.array(at[c]))
            out.append(pa.table([pa.array(uids[m]), pa.array(slot.astype(np.int32)), pa.array(c_uid[at[c]]), ids, pa.array(score)],
                                schema=_FOUND_ARROW))
        return pa.concat_tables(out)

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    along = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("uid"))
    return found.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= most)


def _search(anchors: DataFrame, candidates: DataFrame, shares: int, batches: int, centres, alike: bool, most: int) -> DataFrame:
    """The best `most` candidates of each slot of each anchor (high and cut are arrays over its slots).

    The candidates' shares come in rounds that grow; a round's cuts are what the rounds before it found.
    """
    found, low, high = None, 0, 1
    while low < shares:
        asking = anchors
        if found is not None:
            full = (found.groupBy("anchor", "slot").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == most)
                    .groupBy(F.col("anchor").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("now")))
            raised = F.transform("cut", lambda c, i: F.greatest(c, F.coalesce(F.col("now")[i], c)))
            asking = anchors.join(full, "uid", "left").withColumn("cut", raised).drop("now")
        left = asking.withColumn("share", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).groupBy("share", "batch")
        right = (candidates.where((F.col("share") >= low) & (F.col("share") < high))
                 .withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).groupBy("share", "batch"))
        new = left.cogroup(right).applyInArrow(_cell(centres, alike, most), _FOUND)
        merged = new if found is None else new.unionByName(found.drop("rank"))
        found = stored(_best(merged, most), "found")
        low, high = high, min(shares, high + (high - low) * GROWTH)
    return found


def _finite(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def mine(rows: DataFrame, anchor: Column, label: Column, vec_id: str = "vec_id", embedding: str = "embedding",
         scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A vector's components become floor(scale * x); the score of two rows is their inner product. An anchor's
    positives are its best `POSITIVES` other rows of its label; for each of them the best `NEGATIVES` rows
    of other labels with NEAREST * positive <= 100 * negative <= 100 * positive are returned, higher first, ties by
    smaller id (null ids last, equal ones by the order they are read in).

    Rows with a null label or a vector that is null or holds null or non-finite components take no part, nor do
    rows whose anchor flag is null as anchors. Vectors of different lengths don't meet. Equal rows are separate. Products
    and components beyond a long are the nearest long. Other columns are ignored, whatever their names. An empty
    table, or one without anchors, gives an empty result.

    Anchors are clustered by direction (centres from at most `SAMPLE` anchors, chosen by hash; large clusters are
    cut) and dealt to batches, candidates to shares by hash; every batch meets every share in a task of bounded size.
    There each cluster's list is sorted once by its angular bound and its members walk it until no bound further on can
    matter; cuts from earlier rounds end most walks early.
    """
    v = F.col(embedding).cast("array<double>")
    plain = (rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                         v.alias("v")).where("label is not null").where(_finite(F.col("v")))
             .select(F.monotonically_increasing_id().alias("uid"), "id", "label", "anchor",
                     F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q")))
    table = stored(plain.mapInArrow(_whole, "uid long, id long, label long, anchor boolean, dim int, q binary"), "vectors")
    own = table.where("anchor").drop("anchor")
    n, asked = table.count(), own.count()
    sample = own.select("dim", "q")
    if asked > SAMPLE:
        chosen = F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < F.lit(int((1 << 20) * SAMPLE / asked))
        sample = own.where(chosen).select("dim", "q").limit(2 * SAMPLE)
    by_dim: dict[int, list[bytes]] = {}
    for r in sample.collect():
        by_dim.setdefault(r.dim, []).append(bytes(r.q))
    centres = rows.sparkSession.sparkContext.broadcast(_fit({d: _matrix(q, d) for d, q in by_dim.items() if d}))
    shares, batches = max(1, -(-n // SHARE)), max(1, -(-asked // BATCH))
    assigned = own.mapInArrow(_assign(centres), "uid long, id long, label long, dim int, q binary, cluster int")
    slices = assigned.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / (2 * MEMBERS)).cast("int").alias("slices"))
    slot = F.pmod(F.xxhash64("uid"), F.col("slices"))
    batch = F.pmod(F.xxhash64("dim", "cluster", slot), F.lit(batches)).cast("int")
    anchors = stored(assigned.join(slices, ["dim", "cluster"]).withColumn("batch", batch).drop("slices"), "anchors")
    candidates = table.select("uid", "id", "label", "dim", "q", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(shares)).cast("int").alias("share"))

    first = anchors.withColumns({"high": F.array(F.lit(MOST)), "cut": F.array(F.lit(LEAST))})
    positives = _search(first, candidates, shares, batches, centres, True, POSITIVES)
    # No score fits a negative one. A slot is the place of its positive; those without one take nothing.
    lowest = f"s - (s div 100) * {100 - NEAREST} - ((s % 100) * {100 - NEAREST}) div 100"
    windows = (positives.where("score >= 0").groupBy(F.col("anchor").alias("uid"))
               .agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("p"))
               .select("uid", F.expr(f"transform(sequence(1, {POSITIVES}), i -> p[i])").alias("p"))
               .select("uid", F.expr(f"transform(p, s -> coalesce(s, {LEAST + 1}))").alias("high"),
                       F.expr(f"transform(p, s -> coalesce({lowest}, {MOST}))").alias("cut")))
    second = anchors.join(windows, "uid")
    negatives = _search(second, candidates, shares, batches, centres, False, NEGATIVES)
    of = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (negatives.join(of, ["anchor", "slot"]).join(own.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))

"""Structure of conversations: their faults, and the cheapest edits that make roles alternate.

The edit lattice of a conversation has a node for every (rows done, state of the roles so far); an edge
keeps (K), re-roles (R) or deletes (D) the next row or inserts (I) an empty one before it. A node has at
most one edge of each letter, so an audit, the letters along a path, names its path. Two audits of equal
cost over the same rows are never one the beginning of the other unless it ends in inserts; paths end
with a row here, inserts behind the last row are added by `ENDS`. So (cost, audit) may be minimised piece
by piece, and pieces of one conversation can be solved in different tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import BLANKS, stored

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an inserted or re-roled row leads to, and the role it gets.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What is still to be inserted behind the last row, by state, and its cost.
TAILS = ("", "II", "I", "")
ENDS = tuple(INSERT * len(t) for t in TAILS)
#: Rows searched at once; longer conversations are searched in segments.
SEGMENT = 512
#: Characters of text a sorted partition is meant to hold.
SHARE = 16 << 20
NONE = float("inf")


class Row(NamedTuple):
    initial: str
    blank: bool
    duplicate: bool
    truncated: bool
    copies: int


# ---- the search -----------------------------------------------------------------------------

def _edges(rows: list[Row], i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, i, q) of the edges out of a node, letters ascending; copies of a row follow as deletions."""
    if i == len(rows):
        return
    r = rows[i]
    yield "D", DELETE * r.copies, i + 1, q
    yield "I", INSERT, i, FOLLOWING[q]
    if not (r.blank or r.duplicate):
        cost = TRUNCATED * r.truncated + DELETE * (r.copies - 1)
        kept = KEPT.get((q, r.initial))
        if kept is not None:
            yield "K", cost, i + 1, kept
        yield "R", cost + REROLE, i + 1, FOLLOWING[q]


def _into(rows: list[Row], i: int, q: int) -> Iterator[tuple[int, int, int]]:
    """(cost, i, q) of the nodes with an edge into a node."""
    before = [p for p in range(4) if FOLLOWING[p] == q]
    if i < len(rows):
        for p in before:
            yield INSERT, i, p
    if i:
        r = rows[i - 1]
        yield DELETE * r.copies, i - 1, q
        if not (r.blank or r.duplicate):
            cost = TRUNCATED * r.truncated + DELETE * (r.copies - 1)
            for p in range(4):
                if KEPT.get((p, r.initial)) == q:
                    yield cost, i - 1, p
            for p in before:
                yield cost + REROLE, i - 1, p


def cheapest(rows: list[Row], start: int, ends: tuple) -> tuple[int, str, int] | None:
    """(cost with that of the end, least audit, state at the end) from a state to the ends, or None.

    Two Dijkstra searches, one from the start and one from all ends, in turns of the nearer heap. They
    stop once no path through what is open can be as cheap as the best crossing, so that every path of
    that cost crosses from settled to settled; of all such crossings the least audit is taken.
    """
    n = len(rows)
    ahead, behind = {}, {}  # settled: node to (distance, least audit), node to distance
    front, back = [(0, "", 0, start)], [(c, n, q) for q, c in enumerate(ends) if c < NONE]
    heapq.heapify(back)
    best, radius = NONE, -1
    while (front or back) and (front[0][0] if front else NONE) + (back[0][0] if back else NONE) <= best:
        if front and (not back or front[0][0] <= back[0][0]):
            d, audit, i, q = heapq.heappop(front)
            if (i, q) in ahead:
                continue
            ahead[i, q] = d, audit
            best = min(best, d + behind.get((i, q), ends[q] if i == n else NONE))
            for letter, cost, j, p in _edges(rows, i, q):
                best = min(best, d + cost + behind.get((j, p), NONE))
                if (j, p) not in ahead:
                    heapq.heappush(front, (d + cost, audit + letter, j, p))
        else:
            radius = back[0][0]
            best = min(best, _settle(rows, back, behind, ahead))
    if best == NONE:
        return None
    while back and back[0][0] <= radius:
        _settle(rows, back, behind, ahead)

    onward: dict[tuple, tuple[str, int]] = {}

    def rest(node: tuple) -> tuple[str, int]:
        """The least audit from a settled node to an end: least letter first along tight edges."""
        letters, at = [], node
        while at[0] < n and at not in onward:
            letters.append(next((letter, (j, p)) for letter, cost, j, p in _edges(rows, *at)
                                if behind.get((j, p), NONE) + cost == behind[at]))
            at = letters[-1][1]
        tail = onward.get(at, ("", at[1]))
        onward[node] = "".join(x for x, _ in letters) + tail[0], tail[1]
        return onward[node]

    found = []
    for (i, q), (d, audit) in ahead.items():
        if d + behind.get((i, q), ends[q] if i == n else NONE) == best:
            found.append((audit, "", (i, q)))
            continue
        for letter, cost, j, p in _edges(rows, i, q):
            if d + cost + behind.get((j, p), NONE) == best:
                found.append((audit, letter, (j, p)))
    audit, end = min((a + letter + rest(node)[0], rest(node)[1]) for a, letter, node in found)
    return best, audit, end


def _settle(rows: list[Row], back: list, behind: dict, ahead: dict) -> float:
    """Settle the nearest node of the reverse search; the cost of its best crossing."""
    d, i, q = heapq.heappop(back)
    if (i, q) in behind:
        return NONE
    behind[i, q] = d
    best = d + ahead.get((i, q), (NONE,))[0]
    for cost, j, p in _into(rows, i, q):
        best = min(best, d + cost + ahead.get((j, p), (NONE,))[0])
        if (j, p) not in behind:
            heapq.heappush(back, (d + cost, j, p))
    return best


class Piece(NamedTuple):
    """Costs, and places of the audits among those of one entry, by entry * 4 + exit (None: no way)."""

    costs: list
    places: list


def _piece(found: list[tuple[int, str] | None]) -> Piece:
    places: list = [None] * 16
    for entry in range(4):
        own = sorted((found[entry * 4 + x][1], x) for x in range(4) if found[entry * 4 + x])
        for k, (_, x) in enumerate(own):
            places[entry * 4 + x] = k
    return Piece([f and f[0] for f in found], places)


def chain(pieces: list[Piece], entry: int, ends: tuple) -> tuple[float, list[int]]:
    """(cost, exits) of the cheapest way through pieces in order, of equal ones that of the least audit."""
    costs = [ends]
    for piece in reversed(pieces):
        costs.append(tuple(min((c + h for c, h in zip(piece.costs[e * 4:e * 4 + 4], costs[-1], strict=True)
                                if c is not None), default=NONE) for e in range(4)))
    costs.reverse()
    total, exits = costs[0][entry], []
    if total == NONE:
        return total, exits
    for piece, here, there in zip(pieces, costs, costs[1:], strict=False):
        ways = [(piece.places[entry * 4 + x], x) for x in range(4) if piece.costs[entry * 4 + x] is not None
                and piece.costs[entry * 4 + x] + there[x] == here[entry]]
        entry = min(ways)[1]
        exits.append(entry)
    return total, exits


def _segments(rows: list[Row]) -> tuple[list[Piece], list[list]]:
    pieces, audits = [], []
    for at in range(0, len(rows), SEGMENT):
        part = rows[at:at + SEGMENT]
        found = []
        for entry in range(4):
            for x in range(4):
                way = cheapest(part, entry, tuple(0 if q == x else NONE for q in range(4)))
                found.append(way and way[:2])
        pieces.append(_piece(found))
        audits.append([f and f[1] for f in found])
    return pieces, audits


def _through(pieces, audits, entry: int, ends: tuple) -> tuple[int, str, int] | None:
    cost, exits = chain(pieces, entry, ends)
    if cost == NONE:
        return None
    states = [entry, *exits]
    audit = "".join(a[e * 4 + x] for a, e, x in zip(audits, states, exits, strict=False))
    return cost, audit, states[-1]


def solve(rows: list[Row]) -> tuple[int, str, int]:
    """The cheapest way through a whole conversation of any length."""
    if len(rows) <= SEGMENT:
        return cheapest(rows, START, ENDS)
    return _through(*_segments(rows), START, ENDS)


def solve_piece(rows: list[Row]) -> list[tuple[int, str] | None]:
    """The cheapest ways through a part of a conversation, by entry * 4 + exit."""
    pieces, audits = _segments(rows)
    ways = [_through(pieces, audits, e, tuple(0 if q == x else NONE for q in range(4))) for e in range(4) for x in range(4)]
    return [w and w[:2] for w in ways]


def tokens(rows: list[Row], audit: str, state: int) -> list[str]:
    """What is done at each row: inserts before it (Iu, Ia), then K, D, Ru or Ra, then D for its copies."""
    out, token, i = [], "", 0
    for letter in audit:
        if letter in "IR":
            state = FOLLOWING[state]
            token += letter + ROLE[state][0]
        else:
            state = KEPT[state, rows[i].initial] if letter == "K" else state
            token += letter
        if letter != "I":
            out.append(token + "D" * (rows[i].copies - 1))
            token, i = "", i + 1
    return out


def _spelled(rows: list[Row], audit: str) -> str:
    """The audit with the deletions of copies."""
    if all(r.copies == 1 for r in rows):
        return audit
    out, i = [], 0
    for letter in audit:
        out.append(letter)
        if letter != "I":
            out.append("D" * (rows[i].copies - 1))
            i += 1
    return "".join(out)


# ---- in the tasks ---------------------------------------------------------------------------

_PIECE = ("struct<whole boolean, costs array<bigint>, places array<int>, audits array<string>, end int, sha256 string, "
          "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string>")


def _edit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves the conversations of a sorted partition. The first and the last one may go on in the
    partitions next to it, so all ways through them are kept."""
    part, held, first = TaskContext.get().partitionId(), [], True
    last_key: tuple | None = None
    for b in rows:
        keys = b.column("_c").to_pylist()
        begin = 0
        for i, key in enumerate(keys):
            if (key,) != last_key:
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                if held:
                    yield _solved(held, part, not first)
                    first = False
                held, begin, last_key = [], i, (key,)
        if len(keys) > begin:
            held.append(b.slice(begin))
    if held:
        yield _solved(held, part, False)


def _solved(held: list[pa.RecordBatch], part: int, whole: bool) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    rows = [Row(*x) for x in zip(*(table.column(c).to_pylist() for c in
                                   ("_initial", "_blank", "_duplicate", "_truncated", "_copies")), strict=True)]
    more = [r.copies - 1 for r in rows]
    fact = {"whole": whole, "blank": sum(r.copies for r in rows if r.blank),
            "duplicate": sum(r.copies if r.duplicate else 0 if r.blank else r.copies - 1 for r in rows),
            "truncated": sum(r.truncated for r in rows),
            "illegal": sum(a.initial + b.initial not in LEGAL for a, b in zip(rows, rows[1:], strict=False)) + sum(more),
            "first": rows[0].initial, "last": rows[-1].initial, "end": None, "sha256": None}
    if whole:
        cost, audit, end = solve(rows)
        done = tokens(rows, audit, START)
        edits = [[t] for t in done]
        digest = _digest(zip(table.column("_role").to_pylist(), table.column("_text").to_pylist(), done, strict=True), end)
        fact |= {"costs": [cost], "places": None, "audits": [_spelled(rows, audit) + TAILS[end]], "end": end, "sha256": digest}
    else:
        ways = solve_piece(rows)
        each = [tokens(rows, w[1], k // 4) if w else None for k, w in enumerate(ways)]
        edits = [[e and e[i] for e in each] for i in range(len(rows))]
        piece = _piece(ways)
        fact |= {"costs": piece.costs, "places": piece.places, "audits": [w and _spelled(rows, w[1]) for w in ways]}
    kind = pa.struct([("whole", pa.bool_()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
                      ("audits", pa.list_(pa.string())), ("end", pa.int32()), ("sha256", pa.string()),
                      ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                      ("first", pa.string()), ("last", pa.string())])
    n = len(rows)
    flat = [table.column(c).combine_chunks() for c in ("_c", "_role", "_text")]
    return pa.RecordBatch.from_arrays(
        [*flat, pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int64()),
         pa.array(edits, pa.list_(pa.string())), pa.array([fact] + [None] * (n - 1), kind)],
        names=["_c", "_role", "_text", "_part", "_at", "_edits", "_piece"])


def _messages(role: str, text: str, token: str) -> Iterator[tuple[str, str]]:
    for at, letter in enumerate(token):
        if letter in "IR":
            yield ROLE[USER if token[at + 1] == "u" else ASSISTANT], "" if letter == "I" else text
        elif letter == "K":
            yield role, text


def _digest(rows, end: int) -> str:
    sha, joint = hashlib.sha256(), ""
    for role, text, token in rows:
        for r, t in _messages(role, text, token):
            sha.update(f"{joint}{r}:{t}".encode("utf-8", "surrogatepass"))
            joint = "\n"
    for r in _tail_roles(end):
        sha.update(f"{joint}{r}:".encode())
        joint = "\n"
    return sha.hexdigest()


def _tail_roles(end: int) -> list[str]:
    return [ROLE[USER], ROLE[ASSISTANT]][2 - len(TAILS[end]):]


def _chained(pieces: pa.Table) -> pa.Table:
    """One conversation that lies in several partitions, or at the border of one, from its pieces in order."""
    key = pieces.schema.field("_c").type
    pieces = pieces.sort_by("_part").to_pylist()
    facts = [x["_piece"] for x in pieces]
    plain = [Piece(f["costs"], f["places"]) for f in facts]
    cost, exits = chain(plain, START, ENDS)
    states = [START, *exits]
    ways = [e * 4 + x for e, x in zip(states, exits, strict=False)]
    joints = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(facts, facts[1:], strict=False))
    audit = "".join(f["audits"][w] for f, w in zip(facts, ways, strict=True)) + TAILS[exits[-1]]
    out = {"cost": cost, "audit": audit, "_end": exits[-1], "illegal": sum(f["illegal"] for f in facts) + joints,
           "_ways": [{"part": x["_part"], "way": w} for x, w in zip(pieces, ways, strict=True)]}
    out |= {k: sum(f[k] for f in facts) for k in ("blank", "duplicate", "truncated")}
    kinds = {"cost": pa.int64(), "audit": pa.string(), "_end": pa.int32(), "illegal": pa.int64(),
             "_ways": pa.list_(pa.struct([("part", pa.int32()), ("way", pa.int32())])),
             "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64()}
    return pa.table([pa.array([pieces[0]["_c"]], key), *[pa.array([out[k]], t) for k, t in kinds.items()]],
                    names=["_c", *kinds])


def _streamed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose rows come in order, row by row: SHA-256 can't be put together from parts."""
    key, sha, end = None, None, 0

    def done():
        for r in _tail_roles(end):
            sha.update(f"{joint}{r}:".encode())
        return pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([sha.hexdigest()])], names=["_c", "sha256"])

    for b in rows:
        kind = b.schema.field("_c").type
        for c, role, text, token, e in zip(*(b.column(n).to_pylist() for n in ("_c", "_role", "_text", "_token", "_end")),
                                           strict=True):
            if (c,) != key:
                if sha:
                    yield done()
                key, sha, joint = (c,), hashlib.sha256(), ""
            end = e
            for r, t in _messages(role, text, token):
                sha.update(f"{joint}{r}:{t}".encode("utf-8", "surrogatepass"))
                joint = "\n"
    if sha:
        yield done()


# ---- the operator ---------------------------------------------------------------------------

class Repair(NamedTuple):
    verdicts: DataFrame
    messages: DataFrame


def _judged(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """Rows with their faults, equal ones once with their number."""
    blank = F.lit(" ")
    plain = rows.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(role, blank).alias("_role"),
                        F.coalesce(text, blank).alias("_text"), copies.cast("long").alias("_n"))
    last = F.right(F.rtrim("_text", F.lit(BLANKS)), F.lit(1))
    once = (plain.groupBy("_c", "_t", "_role", "_text").agg(F.sum("_n").alias("_copies"))
            .withColumns({"_k1": F.xxhash64("_role", "_text"), "_k2": F.xxhash64("_text", "_role", F.lit(1)),
                          "_initial": F.substring("_role", 1, 1), "_blank": last == "",
                          "_when": F.struct(F.col("_t").isNotNull(), "_t")}))
    once = stored(once, "turns")
    again = (once.where("not _blank").groupBy(F.col("_c").alias("_c2"), F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"))
             .agg(F.min("_when").alias("_first"), F.count("*").alias("_times")).where("_times > 1").withColumn("_again", F.lit(True)).drop("_times"))
    judged = (once.join(again, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_k1") == F.col("_j1")) &
                        (F.col("_k2") == F.col("_j2")), "left")
              .withColumn("_duplicate", ~F.col("_blank") & F.coalesce("_again", F.lit(False)) & ~F.col("_when").eqNullSafe(F.col("_first")))
              .withColumn("_truncated", ~F.col("_blank") & ~F.col("_duplicate") & ~last.isin(".", "!", "?")))
    return stored(judged.select("_c", "_t", "_role", "_text", "_copies", "_k1", "_k2", "_initial", "_blank", "_duplicate",
                                "_truncated"), "judged")


def _sorted(judged: DataFrame) -> DataFrame:
    """Dealt by ranges of (conversation, turn) and sorted: one conversation may lie in many partitions."""
    size = judged.agg(F.sum(F.length("_text") + 64)).first()[0] or 0
    session = judged.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    order = [F.asc_nulls_first("_c"), F.asc_nulls_first("_t"), F.asc("_role"), F.substring("_text", 1, 64).asc(),
             F.asc("_k1"), F.asc("_k2")]
    return judged.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: Column | None = None) -> Repair:
    """Faults of every conversation and its cheapest repair.

    `verdicts`: `conv`, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; `messages`: the
    repaired rows `conv`, role, text with a `place` that orders them. `copies` says how often a row counts.

    Rows are taken by turn, null turns first, equal turns by role and text (its first 64 characters, then by
    hash). A null role or text is one blank, which is no legal initial and a blank row. Rows equal in all four
    columns follow each other, and all but the first are duplicates. A null conversation id is a conversation
    of its own. Texts of any length are taken whole. Other columns of `rows` are ignored, whatever their names.
    An empty table gives empty tables. Gaps too wide for a long are null.

    Equal rows are counted, not carried; a conversation of any size is cut by turn into the ranges of a sorted
    table, each solved where it lies, and only 16 costs of each range meet. Only the digest of a conversation over
    several ranges is made in one task, row by row, as SHA-256 must be.
    """
    judged = _judged(rows, conv, turn, role, text, F.lit(1) if copies is None else copies)
    key = judged.schema["_c"].dataType.simpleString()
    edits = stored(_sorted(judged).select("_c", "_role", "_text", "_initial", "_blank", "_duplicate", "_truncated", "_copies").mapInArrow(
        _edit, f"_c {key}, _role string, _text string, _part int, _at long, _edits array<string>, _piece {_PIECE}"), "edits")
    facts = edits.where("_piece is not null").select("_c", "_part", "_piece")
    p = F.col("_piece")
    whole = facts.where(p["whole"]).select(
        "_c", p["costs"][0].alias("cost"), p["audits"][0].alias("audit"), p["illegal"].alias("illegal"), p["blank"].alias("blank"),
        p["duplicate"].alias("duplicate"), p["truncated"].alias("truncated"), p["sha256"].alias("sha256"), p["end"].alias("_end"))
    joined = stored(facts.where(~p["whole"]).groupBy("_c").applyInArrow(
        _chained, f"_c {key}, cost long, audit string, _end int, illegal long, _ways array<struct<part int, way int>>, "
                  "blank long, duplicate long, truncated long"), "chains")
    ways = joined.select(F.col("_c").alias("_c2"), "_end", F.explode("_ways").alias("_w")).select(
        "_c2", "_end", F.col("_w.part").alias("_p2"), F.col("_w.way").alias("_way"))
    cut = (edits.where(F.size("_edits") > 1)
           .join(ways, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_part") == F.col("_p2")))
           .select("_c", "_part", "_at", "_role", "_text", F.col("_edits")[F.col("_way")].alias("_token"), "_end"))
    digests = (cut.repartition("_c").sortWithinPartitions("_c", "_part", "_at")
               .mapInArrow(_streamed, f"_c {key}, sha256 string").withColumnRenamed("_c", "_c2"))
    found = whole.drop("_end").unionByName(
        joined.join(digests, F.col("_c").eqNullSafe(F.col("_c2")), "left").drop("_c2", "_ways", "_end"))
    turns = judged.groupBy("_c", "_t").agg(F.lit(1)).groupBy(F.col("_c").alias("_c2")).agg(
        F.coalesce(F.expr("try_add(try_subtract(max(_t), min(_t)), 1L - count(_t))"),
                   F.when(F.count("_t") == 0, F.lit(0))).cast("long").alias("gaps"))
    verdicts = found.join(turns, F.col("_c").eqNullSafe(F.col("_c2"))).select(
        F.col("_c").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha256").alias("repaired_sha256"))
    return Repair(verdicts, _repaired(edits, cut, whole.select("_c", "_end"), joined.select("_c", "_end"), conv))


def _repaired(edits: DataFrame, cut: DataFrame, whole: DataFrame, joined: DataFrame, conv: str) -> DataFrame:
    own = edits.where(F.size("_edits") == 1).select("_c", "_part", "_at", "_role", "_text", F.col("_edits")[0].alias("_token"))
    steps = (own.unionByName(cut.drop("_end"))
             .select("*", F.posexplode(F.expr("regexp_extract_all(_token, '[IR][ua]|[KD]', 0)")).alias("_step", "_op"))
             .where("_op <> 'D'"))
    role = (F.when(F.col("_op") == "K", F.col("_role")).when(F.right("_op", F.lit(1)) == "u", F.lit(ROLE[USER]))
            .otherwise(F.lit(ROLE[ASSISTANT])))
    text = F.when(F.left("_op", F.lit(1)) == "I", F.lit("")).otherwise(F.col("_text"))
    tails = F.element_at(F.array(*[F.array(*[F.lit(r) for r in _tail_roles(e)]).cast("array<string>") for e in range(4)]),
                         F.col("_end") + 1)
    behind = (whole.unionByName(joined).select("_c", F.posexplode(tails).alias("_step", "role"))
              .select("_c", F.struct(F.lit(2147483647).alias("part"), F.lit(0).cast("long").alias("at"), F.col("_step").alias("step"))
                      .alias("place"), "role", F.lit("").alias("text")))
    place = F.struct(F.col("_part").alias("part"), F.col("_at").alias("at"), F.col("_step").alias("step")).alias("place")
    return (steps.select("_c", place, role.alias("role"), text.alias("text")).unionByName(behind)
            .withColumnRenamed("_c", conv))

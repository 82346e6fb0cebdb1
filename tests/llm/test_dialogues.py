"""Repair of conversations against a plain dynamic program over whole audits."""

import hashlib
import random
import zlib

import pytest

from quadlake.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, _c string, cost int"
BLANKS = " \t\n\x0b\f\r"


def brute(rows):
    """rows: (turn, role, text) in order; the contract said row by row, keeping all least audits by state."""
    seen, faults, kinds = set(), dict(blank=0, duplicate=0, truncated=0), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        kind = ("blank" if not bare else "duplicate" if (role, text) in seen else
                "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            faults[kind] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {"": (0, "", ())}  # shape of the roles so far: cost, audit, output

    def with_inserts(states):
        out = dict(states)
        for shape, (c, a, o) in states.items():
            for n in (1, 2):
                s, c2, a2, o2 = shape, c, a, o
                for _ in range(n):
                    s, role = ("u", "user") if s in ("", "s", "a") else ("a", "assistant")
                    c2, a2, o2 = c2 + 2, a2 + "I", (*o2, (role, ""))
                out[s] = min(out.get(s, (9e9,)), (c2, a2, o2))
        return out

    for (_, role, text), kind in zip(rows, kinds):
        after = {}

        def put(shape, value):
            after[shape] = min(after.get(shape, (9e9,)), value)

        for shape, (c, a, o) in with_inserts(best).items():
            put(shape, (c + 3, a + "D", o))
            if kind in ("blank", "duplicate"):
                continue
            t = kind == "truncated"
            keeps = {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
            if role[:1] and role[:1] in keeps:
                put(role[:1], (c + t, a + "K", (*o, (role, text))))
            to = "a" if shape == "u" else "u"
            put(to, (c + 2 + t, a + "R", (*o, ({"u": "user", "a": "assistant"}[to], text))))
        best = after
    cost, audit, out = min(v for k, v in with_inserts(best).items() if k in ("", "a"))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha), out


def by_conversation(rows):
    groups = {}
    for c, t, r, x, *_ in rows:
        groups.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    return {c: sorted(g, key=key) for c, g in groups.items()}


def made(seed, convs=60, longest=12):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None][:rng.choice([3, 8])])
            text = rng.choice(["Yes.", "No", " ", "", None, f"Text {rng.random()}.", f"Cut {rng.random()}", "Why?  \n"])
            turn = rng.choice([t, t, t, t + 1, 7, None])
            rows += [(c if c else None, turn, role, text, "x", 1)] * rng.choice([1, 1, 1, 2])
    return rows


def check(spark, rows, parts=None):
    got = dialogues.repair(spark.createDataFrame(rows, SCHEMA))
    want = by_conversation(rows)
    verdicts = {r[0]: tuple(r)[1:] for r in got.verdicts.collect()}
    messages = {}
    for r in got.messages.orderBy("place").collect():
        messages.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(verdicts) == set(want)
    for c, own in want.items():
        expected, out = brute(own)
        assert verdicts[c] == expected, (c, own)
        assert messages.get(c, []) == list(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_those_of_the_plain_program(spark, seed):
    check(spark, made(seed))


def test_a_hot_conversation_lies_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "SEGMENT", 7)
    rng = random.Random(5)
    hot = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["So.", "So", f"{t}!", " "]), "x", 1) for t in range(900)]
    rows = made(3, 10, 40) + [x for x in hot for _ in range(rng.choice([1, 1, 1, 3]))]
    check(spark, rows)
    judged = dialogues._judged(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text", dialogues.F.lit(1))
    pieces = dialogues._sorted(judged).where("_c = 1").groupBy(dialogues.F.spark_partition_id()).count().count()
    assert pieces > 3


def test_search_equals_the_plain_program_for_any_cut(monkeypatch):
    monkeypatch.setattr(dialogues, "SEGMENT", 3)
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(1, 14)
        rows = [(None, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b", "", f"{i}."])) for i in range(n)]
        expected, _ = brute(rows)
        seen, given = set(), []
        for _, role, text in rows:
            dup = bool(text) and (role, text) in seen
            seen.add((role, text))
            given.append(dialogues.Row(role[:1], not text, dup, bool(text) and not dup and text[-1] != ".", 1))
        cost, audit, end = dialogues.solve(given)
        assert (cost, audit + dialogues.TAILS[end]) == expected[5:7]
        monkeypatch.setattr(dialogues, "SEGMENT", 50)
        cost, audit, end = dialogues.solve(given)
        assert (cost, audit + dialogues.TAILS[end]) == expected[5:7]
        monkeypatch.setattr(dialogues, "SEGMENT", 3)


def test_empty_table(spark):
    got = dialogues.repair(spark.createDataFrame([], SCHEMA))
    assert got.verdicts.count() == 0 and got.messages.count() == 0


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = "" if f == 1 else x.translate({ord(k): None for k in ".!?"}) if f == 2 else x
        r = "user" if f == 4 else " " if r is None else r
        out += [(c, t, r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def test_query_on_damaged_rows(spark, tmp_path):
    from quadlake.llm.queries import QUERIES

    rng = random.Random(4)
    rows = [(c if c else None, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", None]),
             rng.choice(["Fine.", "Is it?", f"{c} {t}", None, ""])) for c in range(80) for t in range(rng.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_dialogue_repair"](spark, str(tmp_path)).collect()}
    want = by_conversation(damaged(rows))
    assert set(got) == {r[0] for r in rows}
    for c, found in got.items():
        empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert found == (brute(want[c])[0] if c in want else empty), c

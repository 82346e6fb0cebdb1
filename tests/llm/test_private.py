import hashlib
import random
import re
from collections import Counter

import numpy as np

from quadlake.llm import private
from quadlake.llm.queries import QUERIES
from tests.llm.cases import documents, frame, saved

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                twice = [d * 2 - 9 * (d * 2 > 9) if k % 2 else d for k, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


ODD = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 999.1.1.1 00255.0.0.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (456) 555-2186 +1",
       "@@a@b..c a@b.c. ++1 23456789(", "é@x.y 4111111111111111é", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "a.b@c.d@e.f@g.h"]


def rows():
    more = [(700 + i, f"word {x} and ü more words\n" * 2, "en", "s", 0) for i, x in enumerate(ODD)]
    more += [(800 + i, f"Text before it bob{i}.x@mail{i % 9}.example.com then 10.0.{i}.7 and +1 (45{i % 10}) 555-21{i % 90 + 10} or "
                       "4111111111111111 after. " * 2, "en", "s", 0) for i in range(60)]
    return documents(n=40) + more


def test_query(spark, tmp_path):
    data = rows()
    got = QUERIES["op4_pii_tagger"](spark, saved(spark, tmp_path, data)).collect()
    text = {r[0]: r[1] or "" for r in data}
    assert len(got) == len(data)
    for r in got:
        base = brute(text[r.doc_id])
        told = [f"{private.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), private.KINDS.index(x.split(":")[0])))


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "@a" * 50_000):
        private.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = private.Tagger()
    sym, tags = rng.integers(0, private.SYMBOLS, (3, 7)), rng.integers(0, private.TAGS, (3, 7))
    _, grads = tagger.step(sym, tags)
    for name, p in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep, losses = p[at], []
        for d in (1e-5, -1e-5):
            p[at] = keep + d
            losses.append(tagger.step(sym, tags)[0])
        p[at] = keep
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-4


def test_held_out_spans_are_found():
    texts = [r[1] for r in rows() if r[0] and r[0] >= 800]
    sym, tags = private.labelled(texts[:40])
    tagger = private.Tagger()
    losses = tagger.fit(sym, tags)
    assert losses[-1] < 0.1 * losses[0]
    sym, tags = private.labelled(texts[40:])
    got, _ = tagger.decode(sym)
    assert (got == tags).mean() > 0.97
    hidden = "Some words before it 1 (451) 555-2133 and after it more words of the text."
    found = private.added_spans(tagger, [hidden, "clean words only"], [[], []])
    assert [hidden[s:e] for s, _, e in found[0]] in ([], ["1 (451) 555-2133"]) and found[1] == []


def test_hidden_spans_are_added_where_few_texts_hold_spans(spark):
    """Personal data only in long texts, among many texts with numbers: the tagger learns from it all the same."""
    rng = random.Random(4)

    def words(k):
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(k))

    def phone():
        return f"1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"

    def name():
        return f"{words(1)}{rng.randint(1, 99)}", f"{words(1)}.example.com"

    def private_text(i):
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return ("@".join(name()), "+" + phone(), ip, "4111 1111 1111 1111")[i % 4]

    clean = [(i, f"{words(9)} {1900 + i % 99} {words(5)} {i * 37}.{i % 7} {words(4)}", "en", "s", 0) for i in range(600)]
    long = [(1000 + i, f"{words(5000)} {private_text(i)} {words(20)}", "en", "s", 0) for i in range(240)]
    df = frame(spark, clean + long)
    assert {r.kind for r in private.sampled(df, "text", 5).collect()} == {0, 1, 2, 3, 4}
    hidden = [(i, f"{words(20)} {phone() if i % 2 else '[@]'.join(name())} {words(20)}", "en", "s", 0) for i in range(60)]
    tagger = private.fit_tagger(df)
    got = private.find_private(frame(spark, hidden).select("doc_id", "text"), tagger=tagger).collect()
    assert not any(r._base for r in got)
    added = Counter(r._spans.split(":")[0] for r in got)
    assert added["phone"] > 10 and added["email"] > 10, added
    found = private.added_spans(tagger, [r[1] for r in clean], [[] for _ in clean])
    assert sum(map(bool, found)) < 6

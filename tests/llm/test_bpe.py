import base64
import hashlib

import public_tokenizers as P
import pytest
import regex
import tiktoken

from quadlake.llm import bpe
from quadlake.llm.common import stored, tidy
from quadlake.llm.queries import QUERIES
from tests.llm.cases import documents, frame, saved

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_matches_library(spark, tmp_path, library):
    rows = documents()
    got = QUERIES["op2_byte_bpe"](spark, saved(spark, tmp_path, rows)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (97, 30), (1000, 16)])
def test_small_chunks_give_the_same_ids(spark, library, chunk, overlap):
    texts = [t for _, t, *_ in documents(n=40) if t] + ["it's  we'll   they'd\n\n\n x" * 20, "a" * 500, " " * 300 + "b"]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.ids for r in bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_merge_of_long_pieces(library):
    for piece in ("ab" * 3000, "tail" * 2000, "é" * 1001, "the" + "x" * 77):
        assert list(bpe.merge(piece.encode(), bpe.Vocabulary(open(RANKS, "rb").read().splitlines()).ranks)) == \
            library.encode_ordinary(piece)


def test_empty_table_and_clashing_names(spark):
    empty = bpe.encode(frame(spark, []), RANKS, P.PATTERN)
    assert empty.count() == 0 and empty.columns[-1] == "ids"
    df = spark.createDataFrame([(1, "a b", [9], "x")], "doc_id long, text string, ids array<int>, chunk string")
    row = bpe.encode(df, RANKS, P.PATTERN).first()
    assert row.chunk == "x" and row.ids != [9]


def test_a_worker_keeps_one_vocabulary(spark, tmp_path):
    short = tmp_path / "short.tiktoken"
    short.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    bpe._LOADED.clear()
    vocabulary, _ = bpe._tools(bpe.Spec(spark, RANKS, P.PATTERN))
    assert bpe._tools(bpe.Spec(spark, RANKS, P.PATTERN))[0] is vocabulary
    other, _ = bpe._tools(bpe.Spec(spark, str(short), P.PATTERN))
    assert len(bpe._LOADED) == 1 and other.ranks != vocabulary.ranks
    assert bpe._tools(bpe.Spec(spark, str(short), "."))[0] is not other and len(bpe._LOADED) == 1
    bpe._LOADED.clear()


def test_short_pieces_merge_like_long_ones(library):
    ranks = bpe.Vocabulary(open(RANKS, "rb").read().splitlines()).ranks
    for piece in ("ab" * 32, "a" * 7, "éßñ" * 5, "qzxjv", "untokenisable", "\u4e2d\u6587" * 6):
        assert list(bpe._merge_few(piece.encode(), ranks)) == list(bpe.merge(piece.encode(), ranks)) == library.encode_ordinary(piece)


def test_chunks_are_encoded_once(spark):
    df = frame(spark, [(1, "word " * 50, None, None, None)])
    plan = bpe.encode(df, RANKS, P.PATTERN, chunk=40, overlap=12)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4  # short texts, ends of chunks, ids of chunks, texts that could not be stitched


def test_ends_of_pieces_where_the_pattern_leaves_some_out():
    assert bpe.pieces_and_ends("ab, cd", regex.compile(r"\w+")) == (["ab", "cd"], [2, 6])
    assert bpe.pieces_and_ends("ab cd", regex.compile(r"\w+|\s")) == (["ab", " ", "cd"], [2, 3, 5])
    assert bpe.pieces_and_ends("", regex.compile(r"\w+")) == ([], [])


def _held():
    """Anonymous memory of this process, in KB."""
    with open("/proc/self/smaps_rollup") as file:
        return next(int(line.split()[1]) for line in file if line.startswith("Anonymous:"))


def test_workers_leave_no_free_memory_behind():
    """What a function over batches used and freed goes back to the system when the task is done."""

    def hoard(rows):
        small = [bytearray(100_000) for _ in range(400)]  # below the size that the C library maps apart
        keep.append(bytearray(100_000))
        del small
        yield from rows

    keep = []
    before = _held()
    assert list(tidy(hoard)(iter([1, 2]))) == [1, 2]
    assert _held() - before < 10_000


def test_the_last_step_drops_the_pieces(spark, tmp_path):
    """Encoded in one pass, decoded in another that says it is the last: only the ranks stay in the worker."""
    ranks, pattern = RANKS, P.PATTERN
    docs = frame(spark, [(i, f"some words{i} and other{i * 7} words", None, None, None) for i in range(50)])
    encoded = stored(bpe.encode(docs, ranks, pattern), "encoded")
    plain = bpe.digests(encoded, ranks, pattern, ["doc_id"]).collect()
    assert sorted(bpe.digests(encoded, ranks, pattern, ["doc_id"], last=True).collect()) == sorted(plain)
    with open(ranks, "rb") as file:
        vocabulary = bpe.Vocabulary(file.read().splitlines())
    ids = bpe.encode_pieces(["some", " words", " zzyzx"], vocabulary)
    assert len(vocabulary) == 3
    vocabulary.forget()
    assert not vocabulary and not vocabulary.older
    assert bpe.decode(ids, vocabulary) == b"some words zzyzx"


def test_a_text_is_handed_over_and_moved_once(spark):
    df = frame(spark, [(1, "a b " * 30, None, None, None), (2, None, None, None, None), (3, "x", None, None, None)])
    encoded = bpe.encode(df, RANKS, P.PATTERN, chunk=40, overlap=12)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    short = plan.split("MapInArrow")[1].split("\n")[1]
    assert "Project" in short and "_text" not in short
    assert "ids" in encoded.columns and {r.doc_id: len(r.ids) for r in encoded.collect()}[2] == 0

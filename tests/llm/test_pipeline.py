import base64
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quadlake.llm import mixing, quality
from tests.llm.cases import documents, frame, saved
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_lines import BLANK, LOWER


def without_lines(rows):
    keys = [[x.strip(BLANK).translate(LOWER) for x in (r[1] or "").split("\n")] for r in rows]
    seen = Counter(k for own in keys for k in set(own))
    return [(r[0], r[1] and "\n".join(x for x, k in zip(r[1].split("\n"), own, strict=True) if not (k and seen[k] >= 10)), *r[2:])
            for r, own in zip(rows, keys, strict=True)]


def test_stages_against_brute_force(spark, tmp_path):
    folder = saved(spark, tmp_path, documents(n=140))
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = without_lines([tuple(r) for r in quality.keep_documents(docs).collect()])
    firsts = {c for _, _, c in groups(kept)}
    rows = list({r for r in kept if r[0] in firsts})
    mixed = mixing.mixed_documents(frame(spark, rows)).collect()
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == sorted((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in mixed)
    assert len(got) > 20


def test_columns_between_stages(spark, tmp_path):
    docs = frame(spark, documents(n=60))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

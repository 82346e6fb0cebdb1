"""The registered queries of these operators over the supplied tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import (bpe, brown, dialogues, jaccard, lines, mixing, negatives, packing, private, quality, recompression,
                          suffixes, vectors)
from quadlake.llm.common import short_batches, table, text_or_empty
from quadlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = partial(_run, fn)
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _run(fn, spark: SparkSession, folder: str) -> DataFrame:
    return fn(short_batches(tune(spark)), folder)


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, pattern)
    return bpe.digests(encoded, ranks, pattern, ["doc_id"])


@query("op8_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


@query("op9_line_dedup", """
WITH lines AS (
    SELECT doc_id, row_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), often AS (
    SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT row_id) >= 10
), marked AS (
    SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id
""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    left = lines.dedup_lines(docs)
    return left.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(text_or_empty(), 256).alias("kept_sha256"))


_QUALITY_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM d
), tri AS (
    SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
    FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1
), rep AS (
    SELECT r, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS offs(o) GROUP BY r
), m AS (
    SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
    FROM d JOIN w ON d.r = w.r LEFT JOIN rep ON d.r = rep.r
), v AS (
    SELECT r, lang, source, measure, value FROM (
        SELECT r, lang, source, n_words, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure,
               unnest([CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END,
                       CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END,
                       CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END,
                       CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END]) AS value
        FROM m) WHERE n_words > 0
), h AS (
    SELECT lang, source, measure, (value >> s) << s AS bucket, count(*) AS n
    FROM (SELECT *, greatest(length(bin(value)) - 7, 0)::INTEGER AS s FROM v) GROUP BY ALL
), own AS (
    SELECT lang, source, measure, any_value(total) AS total,
           min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto,
                 sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM h)
    GROUP BY lang, source, measure
), by_lang AS (
    SELECT lang, measure, any_value(total) AS total,
           min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY bucket) AS upto,
                 sum(n) OVER (PARTITION BY lang, measure) AS total
          FROM (SELECT lang, measure, bucket, sum(n) AS n FROM h GROUP BY ALL))
    GROUP BY lang, measure
), by_none AS (
    SELECT measure, any_value(total) AS total,
           min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY measure ORDER BY bucket) AS upto,
                 sum(n) OVER (PARTITION BY measure) AS total
          FROM (SELECT measure, bucket, sum(n) AS n FROM h GROUP BY ALL))
    GROUP BY measure
), bounds AS (
    SELECT lang, source, measure, q1, q3, greatest((q3 - q1) * 3, slack) AS room FROM (
        SELECT own.lang, own.source, own.measure,
               CASE WHEN own.total >= 200 THEN own.q1 WHEN l.total >= 200 THEN l.q1 ELSE a.q1 END AS q1,
               CASE WHEN own.total >= 200 THEN own.q3 WHEN l.total >= 200 THEN l.q3 ELSE a.q3 END AS q3,
               s.slack
        FROM own JOIN by_lang l ON own.lang IS NOT DISTINCT FROM l.lang AND own.measure = l.measure
        JOIN by_none a ON own.measure = a.measure
        JOIN (VALUES ('symbols', 250), ('dup_lines', 450), ('repeats', 350), ('word_length', 1500)) s(measure, slack)
          ON own.measure = s.measure)
), odd AS (
    SELECT DISTINCT v.r FROM v JOIN bounds b ON v.lang IS NOT DISTINCT FROM b.lang
        AND v.source IS NOT DISTINCT FROM b.source AND v.measure = b.measure
    WHERE v.value > b.q3 + b.room OR (v.measure = 'word_length' AND v.value < b.q1 - b.room)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND odd.r IS NULL AS kept
FROM m LEFT JOIN odd ON m.r = odd.r
"""


@query("op10_quality_rules", _QUALITY_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.verdicts(table(spark, folder, "documents"), carry=["doc_id"])
    return rows.select("doc_id", *[F.col(f"_m.{c}").alias(c) for c in
                                   ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


@query("op3_jaccard_join")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard.near_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.col("_n").alias("n_shingles"), "component_id")


@query("op6_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffixes.dedup_bytes(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                       F.col("_n_spans").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


@query("op7_recompression_dedup")
def recompression_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = recompression.dedup_passages(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                       F.sha2("text", 256).alias("kept_sha256"))


@query("op5_embedding_dedup", """
WITH RECURSIVE ok AS (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN n ON e.vec_id = n.a
""")
def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@query("op1_brown_lm")
def brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    scored = brown.scored(table(spark, folder, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_pii_tagger")
def pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    found = private.find_private(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"_{k}").alias(f"n_{k}") for k in private.KINDS],
                        F.sha2("_base", 256).alias("base_sha256"), F.col("_spans").alias("spans"))


_DIALOGUE_SQL = """
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), crc AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1),
        lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS f
    FROM src
), damaged AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM crc
), placed AS (
    SELECT *, left(role, 1) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS joint, count(*) OVER (PARTITION BY conv_id) AS n
    FROM placed
), walk AS (
    SELECT conv_id, 0::BIGINT AS pos, {c: 0, a: '', o: []::VARCHAR[]} AS q0, {c: 99999999, a: '', o: []::VARCHAR[]} AS qs,
           {c: 99999999, a: '', o: []::VARCHAR[]} AS qu, {c: 99999999, a: '', o: []::VARCHAR[]} AS qa
    FROM (SELECT DISTINCT conv_id FROM judged)
    UNION ALL
    SELECT conv_id, pos,
        {c: q0.c + 3, a: q0.a || 'D', o: q0.o},
        list_sort([{c: qs.c + 3, a: qs.a || 'D', o: qs.o},
                   {c: q0.c + t + CASE WHEN i = 's' THEN 0 ELSE 99999999 END, a: q0.a || 'K', o: list_append(q0.o, own)}])[1],
        list_sort([{c: eu.c + 3, a: eu.a || 'D', o: eu.o},
                   {c: pre.c + t + CASE WHEN i = 'u' THEN 0 ELSE 99999999 END, a: pre.a || 'K', o: list_append(pre.o, own)},
                   {c: pre.c + t + 2, a: pre.a || 'R', o: list_append(pre.o, 'user:' || text)}])[1],
        list_sort([{c: ea.c + 3, a: ea.a || 'D', o: ea.o},
                   {c: eu.c + t + CASE WHEN i = 'a' THEN 0 ELSE 99999999 END, a: eu.a || 'K', o: list_append(eu.o, own)},
                   {c: eu.c + t + 2, a: eu.a || 'R', o: list_append(eu.o, 'assistant:' || text)}])[1]
    FROM (
        SELECT *, list_sort([q0, qs, ea])[1] AS pre FROM (
            SELECT w.conv_id, j.pos, j.i, j.text, j.role || ':' || j.text AS own, q0, qs,
                   CASE j.fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 99999999 END AS t,
                   list_sort([qu, {c: q0.c + 2, a: q0.a || 'I', o: list_append(q0.o, 'user:')},
                              {c: qs.c + 2, a: qs.a || 'I', o: list_append(qs.o, 'user:')},
                              {c: qa.c + 2, a: qa.a || 'I', o: list_append(qa.o, 'user:')}])[1] AS eu,
                   list_sort([qa, {c: qu.c + 2, a: qu.a || 'I', o: list_append(qu.o, 'assistant:')}])[1] AS ea
            FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = w.pos + 1))
), ended AS (
    SELECT conv_id, list_sort([q0, qa, {c: qu.c + 2, a: qu.a || 'I', o: list_append(qu.o, 'assistant:')},
        {c: qs.c + 4, a: qs.a || 'II', o: list_concat(qs.o, ['user:', 'assistant:'])}])[1] AS best
    FROM walk w WHERE pos = (SELECT max(n) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM w.conv_id)
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (joint NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s
LEFT JOIN facts f ON s.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN ended e ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op11_dialogue_repair", _DIALOGUE_SQL)
def dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    damaged = (rows.withColumn("kind", kind).where("kind <> 0")
               .withColumns({"text": F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(text, ".!?", ""))
                             .otherwise(text), "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(role)}))
    found = dialogues.repair(damaged, copies=F.when(F.col("kind") == 3, 2).otherwise(1)).verdicts
    all_ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    out = all_ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_id").alias("conv_id"),
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, carry=["doc_id"])
    return packing.pack(pieces)


@query("op13_hard_negatives", """
WITH fit AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS r
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
           list_dot_product(a.q, b.q)::BIGINT AS score
    FROM fit a JOIN fit b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT r, anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.r, positive_id ORDER BY score DESC, other))::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON p.r = s.r AND NOT s.alike
    AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label)

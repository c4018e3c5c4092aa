"""Registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import bestfit, bpe, classifier, lines, lm, minhash, packing, rules, runs, scan, suffixes, tokenfile, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_bpe_pair_index(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.digest(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op2_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


@_query
def op3_segment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that stand, up to two edits, in an earlier place."""
    return lines.digest(_table(spark, folder, "documents"), threshold=2, least_chars=1)


@_query
def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base counts and the verdict of its host's frequent lines."""
    return rules.line_frequency(_table(spark, folder, "documents"))


ORACLES["op4_line_frequency"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), grams AS (
    SELECT id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g
    FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), twice AS (
    SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM grams) WHERE n > 1
), repeated AS (
    SELECT id, sum(least(5, coalesce(lead_i - i, 5)))::BIGINT AS n
    FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS lead_i FROM twice) GROUP BY id
), l AS (
    SELECT id, host, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
        array_to_string(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'), ' ') AS norm
    FROM (SELECT id, host, unnest(string_split(text, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
    SELECT id, count(*) - count(DISTINCT l) AS n FROM l GROUP BY id
), hosts AS (
    SELECT host, count(*) AS n FROM d GROUP BY host
), often AS (
    SELECT host, norm FROM (SELECT host, norm, count(DISTINCT id) AS n FROM l GROUP BY host, norm) x
    JOIN hosts USING (host) WHERE x.n > 20 AND x.n > 0.1 * hosts.n
), removed AS (
    SELECT id, sum(n)::BIGINT AS n FROM l JOIN often USING (host, norm) GROUP BY id
), base AS (
    SELECT d.id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
    FROM d JOIN w USING (id) LEFT JOIN dup USING (id) LEFT JOIN repeated USING (id) LEFT JOIN removed USING (id)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.5 * n_words AS kept,
    n_removed_words
FROM judged
"""


@_query
def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products for every 50th vector against all others."""
    vectors = _table(spark, folder, "embeddings")
    return topk.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5, scale=256)


ORACLES["op5_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op6_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's marginal probability over all segmentations, and its word score."""
    return lm.score(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_suffix_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-byte strings that a document with a smaller id has."""
    return suffixes.digest(_table(spark, folder, "documents"), length=50)


@_query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score by attention over its passages."""
    docs = _table(spark, folder, "documents")
    return classifier.score(docs, classifier.fit(docs, _table(spark, folder, "labels")), threshold=0.7)


@_query
def op9_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place and ids, read back from the token shards."""
    shards = tokenfile.write(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read(shards)


@_query
def op10_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return minhash.classes(_table(spark, folder, "documents"))


@_query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's periodic runs of words, and digests of them and of the text without their repeats."""
    return runs.digest(_table(spark, folder, "documents"), least=24, exponent=3)


@_query
def op12_dominance_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in sequences of at most 4096 ids."""
    return bestfit.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=1)


@_query
def op13_automaton_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty documents with the highest lexical score for every benchmark item."""
    return scan.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=50)


ORACLES["op13_automaton_search"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), sizes AS (
    SELECT id, doc_id, len(w) AS n FROM d WHERE len(w) > 0
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), hits AS (
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM hits GROUP BY term), totals
), parts AS (
    SELECT id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part
    FROM hits JOIN weights USING (term) JOIN sizes USING (id), totals
), scores AS (
    SELECT item_id, doc_id, id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) JOIN sizes USING (id)
    GROUP BY item_id, doc_id, id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

"""Ranked lexical search by scanning: an Aho-Corasick automaton of all items' terms counts them in the texts themselves.

Texts are not indexed. A term is a maximal match, so the automaton holds each
term between two guards and reads texts in which every character that no term
has is a guard; a hit is then the whole term and never a part of a longer one.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import blocks, per_worker, release, stored

#: Bytes of item terms in one automaton; items beyond that are searched in further passes.
PASS_BYTES = 8 << 20
#: Scores held at once while a task ranks, and (document, item) pairs before a cut to the best.
SCORES = 1 << 21
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = b" "
#: A-Z to lower case, every other ASCII character but letters and digits to the guard.
_GUARDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else GUARD[0] for b in range(256)
)
HITS = "doc_id long, n long, terms binary, tfs binary, summary boolean"


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of each item; rows with one id are one item, null texts have none."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    terms = F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(1)))
    return items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("term")).distinct()


def automaton(terms: list[str]):
    """Finds each term between guards; an output is the term's number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    guard = GUARD.decode()
    for number, term in enumerate(terms):
        found.add_word(guard + term + guard, number)
    if terms:
        found.make_automaton()
    return found


def guarded(raw: bytes) -> bytes:
    """The text between guards, lower-cased, with guards for all characters that no term has."""
    return GUARD + raw.translate(_GUARDED) + GUARD


def _scanned(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Each document's hits, and per task a row of totals: documents with a term, terms, and documents by term."""
    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast(terms), f"automaton:{uuid.uuid4().hex}"

    def run(batches):
        words = shared.value
        machine = per_worker(name, lambda: automaton(words))
        with_term = total = 0
        frequency = np.zeros(len(words), np.int64)
        second = itemgetter(1)

        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n", "terms", "tfs", "summary"])

        for batch in blocks(batches):
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = guarded(raw)
                n = len(text.split())
                if not n:
                    continue
                with_term += 1
                total += n
                if not words:
                    continue
                counts = Counter(map(second, machine.iter(text.decode("utf-8", "replace"))))
                if counts:
                    hit = np.fromiter(counts.keys(), "<i4", len(counts))
                    frequency[hit] += 1
                    rows.append((doc, n, hit.tobytes(), np.fromiter(counts.values(), "<i4", len(counts)).tobytes(), False))
            yield batch_of(rows)
        if with_term:
            hit = np.flatnonzero(frequency)
            yield batch_of([(with_term, total, hit.astype("<i4").tobytes(), frequency[hit].astype("<i8").tobytes(), True)])
        release()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, HITS))


def _statistics(hits: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents by term number (one row per term reaches the driver)."""

    def run(batches):
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("tfs").to_pylist()):
                yield pa.record_batch(
                    [pa.array(np.frombuffer(terms, "<i4"), pa.int64()), pa.array(np.frombuffer(counts, "<i8"))], names=["term", "n"]
                )

    totals = hits.filter("summary")
    documents, words = totals.agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(size, np.int64)
    rows = totals.select("terms", "tfs").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in rows.collect():
        frequency[term] = n
    return documents, words, frequency


def weight(documents: int, holding: int) -> int:
    """Weight of a term in ``holding`` of ``documents``."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(n: int, documents: int, words: int) -> int:
    """100 times 1 - b + b * n / average, with b a half."""
    return 100 - 50 + (50 * n * documents) // words


class Best:
    """The k best documents of each item among those offered, as parallel arrays."""

    def __init__(self, items: int, k: int):
        self.k, self.limit = k, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of a block: one row per document, one column per item."""
        row, item = np.nonzero(scores >= self.limit)
        self.waiting.append((item, scores[row, item], null[row], ids[row]))
        self.size += len(row)
        if self.size > SCORES:
            self.cut()

    def cut(self) -> None:
        """Keep the k best of each item; a later one has to reach the k-th."""
        item, score, null, ids = columns = [np.concatenate(c) for c in zip(self.held, *self.waiting)]
        order = np.lexsort((ids, null, -score, item))
        first = np.flatnonzero(np.diff(item[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.held = [c[order[place < self.k]] for c in columns]
        last = order[place == self.k - 1]
        self.limit[item[last]] = score[last]
        self.waiting, self.size = [], 0


def _ranked(hits: DataFrame, weights: np.ndarray, norms: tuple[int, int], owners: list[np.ndarray], ids: list[int | None], k: int) -> DataFrame:
    """``item_id, doc_id, score, task``: the k best documents of each task's part for each item."""
    size = len(ids)
    shared = hits.sparkSession.sparkContext.broadcast(
        (weights, np.cumsum([0, *map(len, owners)]), np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64))
    )
    # float sums are exact up to here
    most = int(weights.max(initial=0)) * 1_000_000 * len(weights)

    def run(batches):
        from pyspark import TaskContext

        weight_of, bounds, items = shared.value
        best = Best(size, k)
        step = max(1, SCORES // size)

        def offer(docs, lengths, terms, tfs):
            counts = np.array([len(t) for t in terms])
            term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.int64)
            norm = np.array([20 * length_norm(n, *norms) for n in lengths], np.int64)
            value = weight_of[term] * (1_000_000_000 * tf // (1000 * tf + np.repeat(norm, counts)))
            row = np.repeat(np.arange(len(docs)), counts)
            each = bounds[term + 1] - bounds[term]
            at = np.repeat(bounds[term] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            place, value = np.repeat(row, each) * size + items[at], np.repeat(value, each)
            if most < 1 << 53:
                scores = np.bincount(place, value, len(docs) * size).astype(np.int64)
            else:
                scores = np.zeros(len(docs) * size, np.int64)
                np.add.at(scores, place, value)
            null = np.array([d is None for d in docs], np.int64)
            best.offer(scores.reshape(len(docs), size), np.array([0 if d is None else d for d in docs], np.int64), null)

        for batch in batches:
            docs, lengths = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            terms = [np.frombuffer(t, "<i4") for t in batch.column("terms").to_pylist()]
            tfs = [np.frombuffer(t, "<i4") for t in batch.column("tfs").to_pylist()]
            at = 0
            while at < len(docs):
                # a block of few rows and few postings; one document at least
                end, postings = at, 0
                while end < len(docs) and end - at < step and (end == at or postings < SCORES):
                    postings += int((bounds[terms[end] + 1] - bounds[terms[end]]).sum())
                    end += 1
                offer(docs[at:end], lengths[at:end], terms[at:end], tfs[at:end])
                at = end
        best.cut()
        item, score, null, found = best.held
        task = TaskContext.get().partitionId()
        yield pa.record_batch(
            [
                pa.array([ids[i] for i in item.tolist()], pa.int64()),
                pa.array(found, pa.int64(), mask=null.astype(bool)),
                pa.array(score, pa.int64()),
                pa.array(np.full(len(item), task), pa.int64()),
            ],
            names=["item_id", "doc_id", "score", "task"],
        )

    rows = hits.filter("NOT summary").select("doc_id", "n", "terms", "tfs")
    return rows.mapInArrow(run, "item_id long, doc_id long, score long, task long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The ``k`` documents with the highest lexical score above 0 for each item.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``;
    other columns are ignored. Terms are the maximal matches of ``TERM`` with A-Z
    lower-cased. Documents are scanned where they lie; what is kept of one are
    the numbers and frequencies of the item terms in it. Scores are integers.

    Items are dealt into passes of about ``pass_bytes`` of distinct terms, each
    with an automaton and scan of its own, so what is broadcast is bounded
    however many items there are; an item's own terms have to fit in memory.
    A task keeps the k best of its part for each item; winners are merged twice,
    first in groups of tasks.

    Null and empty texts have no terms: such a document is not counted and such
    an item has no rows. Rows with one ``item_id`` (null as well) are one item
    with the terms of all. Repeated documents count and rank once each; ties go
    to the smaller id, null ids last. Empty tables give no rows.

    Returns ``item_id, rank, doc_id, score``.
    """
    terms = stored(item_terms(items))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / pass_bytes))
    found = []
    for number in range(passes):
        part = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        pairs = part.collect()
        words = sorted({term for _, term in pairs})
        ids = sorted({item for item, _ in pairs}, key=lambda i: (i is None, i or 0))
        if not ids:
            continue
        place, numbers = {w: i for i, w in enumerate(words)}, {item: i for i, item in enumerate(ids)}
        owners: list[list[int]] = [[] for _ in words]
        for item, term in pairs:
            owners[place[term]].append(numbers[item])
        hits = _scanned(docs, words)
        documents, total, frequency = _statistics(hits, len(words))
        weights = np.array([weight(documents, int(n)) for n in frequency], np.int64)
        found.append(_ranked(hits, weights, (documents, total), [np.array(o, np.int64) for o in owners], ids, k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    winners = reduce(DataFrame.unionByName, found).withColumn("part", F.col("task") % 256)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        winners = winners.withColumn("rank", rank).filter(F.col("rank") <= k)
    return winners.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

"""Packing by lexical retrieval: a BM25 index per shard finds unused neighbours that fill a seed's window."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import blocks, stored, text_of
from wearline.llm.tokens import encoder

SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sketch long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_SEEDS = np.array([[0x5BD1E995], [0x1B873593]], np.uint32)


def _mixed(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit integers for each seed."""
    x = (x.astype(np.uint32) ^ seeds) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Whole windows (without ids), tails with ids and a sketch, and per task one row of document frequencies (length -1)."""

    def run(batches):
        encode = encoder(path)
        kind, total, rows = encode.dtype, 0, []
        end = kind.type(end_id).tobytes()
        frequency = np.zeros(encode.tokenizer.get_vocab_size() + end_id + 1, np.int64)

        def flush():
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            types = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sketch", "ids"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in blocks(batches):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encode.ids(batch.column("text").to_pylist())):
                ids = np.frombuffer(raw + end, kind)
                n, tail = len(ids), len(ids) // window * window
                ordered = np.sort(ids)
                frequency[ordered[np.append(True, ordered[1:] != ordered[:-1])]] += 1
                total += 1
                rows += [(doc, at, window, _crc(ids[at : at + window]), n, 0, None) for at in range(0, tail, window)]
                if tail < n:
                    first, second = _mixed(ids[tail:], _SEEDS).min(axis=1).tolist()
                    rows.append((doc, tail, n - tail, 0, n, first << 31 | second >> 1, ids[tail:].tobytes()))
            yield flush()
        if total:
            terms = np.flatnonzero(frequency)
            rows.append((None, total, -1, 0, 0, 0, np.stack([terms, frequency[terms]]).astype("<i8").tobytes()))
            yield flush()

    return stored(text_of(docs).mapInArrow(run, PIECES))


def _frequencies(pieces: DataFrame) -> tuple[int, dict[int, int]]:
    """Documents in all, and for each token id the documents it is in: at most one row per vocabulary entry reaches the driver."""

    def run(batches):
        for batch in batches:
            for total, raw in zip(batch.column("start").to_pylist(), batch.column("ids").to_pylist()):
                terms, counts = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.record_batch(
                    [pa.array(np.append(terms, -1)), pa.array(np.append(counts, total))], names=["term", "n"]
                )

    rows = pieces.filter("length = -1").select("start", "ids").mapInArrow(run, "term long, n long")
    found = {r[0]: r[1] for r in rows.groupBy("term").agg(F.sum("n")).collect()}
    return found.pop(-1, 0), found


class ShardIndex:
    """BM25 postings of one shard's tails; statistics are those of the whole corpus."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray):
        sizes = np.array([len(t) for t in tails])
        rows = np.repeat(np.arange(len(tails)), sizes)
        key = np.concatenate(tails).astype(np.int64) * len(tails) + rows
        key, tf = np.unique(key, return_counts=True)
        terms, rows = key // len(tails), key % len(tails)
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        weight = idf[terms] * tf * (K1 + 1) / (tf + norm[rows])
        useful = weight > 0
        terms, self.rows, self.weight = terms[useful], rows[useful], weight[useful].astype(np.float32)
        names, starts = np.unique(terms, return_index=True)
        self.postings = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)])))
        # 16-bit numbers are sorted in linear time
        order = np.argsort(self.rows.astype(np.uint16) if len(tails) <= 1 << 16 else self.rows, kind="stable")
        cuts = np.searchsorted(self.rows[order], np.arange(len(tails) + 1))
        self.terms_of = [terms[order[a:b]].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        self.n = len(tails)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every tail for the seed's terms."""
        spans = [self.postings[t] for t in self.terms_of[seed]]
        if not spans:
            return np.zeros(self.n)
        rows = np.concatenate([self.rows[a:b] for a, b in spans])
        return np.bincount(rows, np.concatenate([self.weight[a:b] for a, b in spans]), self.n)


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (tail, from, to) that hold every token once.

    The first unused tail is the seed; neighbours follow by falling score, ties
    by place. One that does not fit is cut there and the rest stays unused. What
    is left at the end, less than a window, goes into sequences whose lengths
    are powers of two, so nothing is padded.
    """
    index = ShardIndex(tails, idf)
    sizes = np.array([len(t) for t in tails])
    used = np.zeros(len(tails), np.int64)
    left, seed, sequences = int(sizes.sum()), 0, []
    while left >= window:
        while used[seed] == sizes[seed]:
            seed += 1
        open_tails = np.flatnonzero(used < sizes)
        ranked = open_tails[np.argsort(-index.scores(seed)[open_tails], kind="stable")]
        pieces, space = [], window
        for i in [seed, *ranked[ranked != seed].tolist()]:
            take = min(space, int(sizes[i] - used[i]))
            pieces.append((i, int(used[i]), int(used[i]) + take))
            used[i] += take
            space -= take
            if not space:
                break
        sequences.append(pieces)
        left -= window
    rest = [(int(i), int(used[i]), int(sizes[i])) for i in np.flatnonzero(used < sizes)]
    while left:
        space = 1 << (left.bit_length() - 1)
        left -= space
        pieces = []
        while space:
            i, a, b = rest.pop(0)
            end = min(b, a + space)
            pieces.append((i, a, end))
            space -= end - a
            if end < b:
                rest.insert(0, (i, end, b))
        sequences.append(pieces)
    return sequences


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every token of ``docs`` in exactly one piece of one sequence of at most ``window`` tokens.

    A document's ids end with ``end_id`` (null or empty text: that id alone). Its
    whole windows are sequences of their own; tails are range-partitioned by a
    min-hash sketch of their ids, so like texts and copies lie together however
    many there are, and cut into shards of ``shard_tokens`` tokens. A shard's
    BM25 index (terms are token ids, statistics those of all documents) returns
    unused neighbours for each seed. Repeated rows are packed once each; an
    empty table gives no rows. ``window`` must be a power of two.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    pieces = _tokenised(docs, tokenizer_path, window, end_id)
    total, frequency = _frequencies(pieces)
    idf = np.zeros(max(frequency, default=0) + 1)
    for term, n in frequency.items():
        idf[term] = max(0.0, np.log((total - n + 0.5) / (n + 0.5)))
    shared = spark.sparkContext.broadcast(idf)

    def run(batches):
        from pyspark import TaskContext

        kind = encoder(tokenizer_path).dtype
        base, number = TaskContext.get().partitionId() << 40, 0
        held, size = [], 0

        def shard():
            nonlocal number
            tails = [np.frombuffer(r["ids"], kind) for r in held]
            out = []
            for sequence in pack_shard(tails, shared.value, window):
                offset = 0
                for i, a, b in sequence:
                    row = held[i]
                    out.append((row["doc_id"], row["start"] + a, b - a, _crc(tails[i][a:b]), row["doc_tokens"], base + number, offset))
                    offset += b - a
                number += 1
            return _packed(out)

        for batch in batches:
            whole = []
            for row in batch.to_pylist():
                if row["ids"] is None:
                    whole.append((row["doc_id"], row["start"], row["length"], row["ids_crc32"], row["doc_tokens"], base + number, 0))
                    number += 1
                    continue
                held.append(row)
                size += row["length"]
                if size >= shard_tokens:
                    yield shard()
                    held, size = [], 0
            yield _packed(whole)
        if held:
            yield shard()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["sketch", "doc_id", "start", "doc_tokens"]
    rows = pieces.filter("length >= 0").repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "ids")
    return rows.mapInArrow(run, PACKED)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

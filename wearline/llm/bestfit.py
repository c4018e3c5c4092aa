"""Best-fit packing after dominance reduction, for whole corpora.

Packing looks at lengths only, and there are at most ``window`` of them: the
instance is the number of pieces of each length, whatever the corpus. On it the
driver fixes dominating sets and packs the remainder by best fit, many equal
sequences at a time; the pieces then look up their own place by length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import blocks, stored, text_of
from wearline.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_RANK_BITS = 42


class Plan:
    """Where the pieces of each length go: rows of (length, first rank, pieces a sequence, first sequence, offset).

    Ranks ``first``, ``first + 1``, ... fill one sequence after another from the
    given offset on. Rows of one length follow each other by rank.
    """

    def __init__(self, counts: np.ndarray, window: int):
        self.window = window
        self.left = counts.astype(object)
        self.given = [0] * (window + 1)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def place(self, length: int, sequences: int, each: int, first: int, offset: int) -> None:
        """The next pieces of ``length``, ``each`` in every one of ``sequences`` from ``first``."""
        self.rows.append((length, self.given[length], each, first, offset))
        self.given[length] += sequences * each
        self.left[length] -= sequences * each

    def fix(self, lengths: tuple[int, ...], copies: int) -> None:
        """``copies`` new sequences that hold exactly ``lengths``."""
        offset = 0
        for length, each in sorted(Counter(lengths).items(), reverse=True):
            self.place(length, copies, each, self.sequences, offset)
            offset += length * each
        self.sequences += copies
        self.fixed += copies

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of length and first rank, and the rows' other columns."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return rows[:, 0] << _RANK_BITS | rows[:, 1], rows


def dominating(left: np.ndarray, length: int, window: int) -> tuple[int, ...] | None:
    """Lengths of a set with a piece of ``length`` that dominates every other set with it, if one of at most three is known to.

    A set dominates another if the other's pieces can be dealt into groups that
    are each no longer than one of its own pieces; exchanging them shows that
    some best packing has the set as a sequence. ``left`` counts the pieces by length.
    """
    others = left.copy()
    others[length] -= 1
    room = window - length
    sizes = np.flatnonzero(others[: room + 1] > 0)
    if not len(sizes):
        return (length,)
    largest = int(sizes[-1])
    if largest == room:
        return (length, largest)
    few = np.repeat(sizes[:3], np.minimum(others[sizes[:3]].astype(np.int64), 3))[:3]
    if len(few) < 2 or few[0] + few[1] > room:
        return (length, largest)
    if len(few) == 3 and few.sum() <= room:
        return None
    # at most two others fit; the longest partner of each, itself only if there are two
    wanted = np.minimum(sizes, room - sizes)
    partner = np.searchsorted(sizes, wanted, side="right") - 1
    alone = (partner == np.arange(len(sizes))) & (others[sizes].astype(np.int64) < 2)
    partner = partner - alone
    sums = np.where(partner >= 0, sizes + sizes[partner], 0)
    if largest >= sums.max():
        return (length, largest)
    others[largest] -= 1
    seconds = np.flatnonzero(others[: room - largest + 1] > 0)
    others[largest] += 1
    if not len(seconds):
        return None
    second = int(seconds[-1])
    above = sizes[sizes > second]
    pair = np.repeat(above[:2], np.minimum(others[above[:2]].astype(np.int64), 2))[:2]
    if len(pair) < 2 or pair.sum() > room:
        return (length, largest, second)
    return None


def reduce(plan: Plan) -> None:
    """Fix dominating sets, longest piece first, until no more are known.

    Taking pieces away keeps a set dominating, so equal sets are fixed at once.
    """
    changed = True
    while changed:
        changed = False
        for length in np.flatnonzero(plan.left > 0)[::-1].tolist():
            while plan.left[length] > 0:
                found = dominating(plan.left, length, plan.window)
                if found is None:
                    break
                plan.fix(found, min(plan.left[x] // n for x, n in Counter(found).items()))
                changed = True


def best_fit(plan: Plan) -> None:
    """The remaining pieces, longest first, each into the fullest sequence with room for it.

    Sequences with equal room are ranges of numbers. One that takes a piece is
    then the fullest, so it takes as many of that length as it has room for.
    """
    window = plan.window
    open_rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                insort(open_rooms, room)
            ranges[room].append((first, n))

    for length in np.flatnonzero(plan.left > 0)[::-1].tolist():
        while plan.left[length] > 0:
            at = bisect_left(open_rooms, length)
            if at < len(open_rooms):
                room = open_rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], open_rooms[at]
            else:
                room, first = window, plan.sequences
                n = -(-plan.left[length] // (window // length))
                plan.sequences += n
            each = room // length
            full = min(n, plan.left[length] // each)
            if full:
                plan.place(length, full, each, first, window - room)
                keep(room - length * each, first, full)
            rest = plan.left[length] if full < n else 0
            if rest:
                plan.place(length, 1, rest, first + full, window - room)
                keep(room - length * rest, first + full, 1)
                full += 1
            keep(room, first + full, n - full)


def planned(counts: np.ndarray, window: int) -> Plan:
    """The packing of ``counts[length]`` pieces of each length up to ``window``."""
    plan = Plan(counts, window)
    reduce(plan)
    best_fit(plan)
    return plan


def least_sequences(counts: np.ndarray, window: int) -> int:
    """A lower bound of the number of sequences (Martello and Toth's L2).

    For each limit k: pieces longer than ``window`` - k need a sequence each,
    those longer than half have the rest of theirs, and what the pieces of k or
    more exceed that by needs further sequences.
    """
    counts = counts.astype(object)
    best, half = -(-sum(i * int(n) for i, n in enumerate(counts)) // window), window // 2
    for k in np.flatnonzero(counts[: half + 1] > 0).tolist():
        alone = int(counts[window - k + 1 :].sum())
        middle = counts[half + 1 : window - k + 1]
        spare = sum((window - i) * int(n) for i, n in enumerate(middle, half + 1))
        small = sum(i * int(n) for i, n in enumerate(counts[k : half + 1], k))
        best = max(best, alone + int(middle.sum()) + max(0, -(-(small - spare) // window)))
    return max(best, int(counts[half + 1 :].sum()))


def _pieces(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Every document's pieces, each with its task and its number among the task's pieces of that length."""

    def run(batches):
        from pyspark import TaskContext

        encode, task = encoder(path), TaskContext.get().partitionId()
        kind, seen = encode.dtype, Counter()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in blocks(batches):
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encode.ids(batch.column("text").to_pylist())):
                ids = np.append(np.frombuffer(raw, kind), kind.type(end_id)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), window)):
                    part = ids[at : at + window]
                    rows.append((doc, i, at, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return stored(text_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, PIECES))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document in one sequence of at most ``window`` tokens, in as few sequences as dominance and best fit give.

    A document's ids end with ``end_id`` (null or empty text: that id alone).
    Only a longer one is cut, into pieces of ``window`` tokens and a rest.
    Repeated rows are packed once each, a null id is kept, extra columns are
    ignored, an empty table gives no rows; a text is encoded whole by one task.

    The texts are read once and not shuffled. The driver gets one row per
    length. A piece's rank among all of its length is its number within its task
    plus the pieces of earlier tasks, so a frequent length is no hot key. The
    plan's rows, broadcast, are bounded by the window, not by the corpus: best
    fit splits a range of like sequences at most twice per length, and a range
    holds few lengths.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    pieces = _pieces(docs, tokenizer_path, window, end_id)
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("pieces"))
    counts = np.zeros(window + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("pieces")).collect():
        counts[length] = n
    table = docs.sparkSession.sparkContext.broadcast(planned(counts, window).table())
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    def run(batches):
        keys, rows = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = rows[np.searchsorted(keys, length << _RANK_BITS | rank, side="right") - 1]
            after = rank - row[:, 1]
            places = [row[:, 3] + after // row[:, 2], row[:, 4] + after % row[:, 2] * length]
            yield pa.record_batch(
                [*(batch.column(c) for c in batch.schema.names[:-1]), *map(pa.array, places)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*kept, "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

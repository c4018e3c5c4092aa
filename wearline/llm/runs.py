"""Periodic runs of words by suffix trees: Ukkonen trees of a text and its reversal answer longest common extensions.

By the runs theorem every maximal repetition has a root that is the longest
Lyndon word at its place, for one of two opposite orders of the alphabet. A
depth-first walk of the tree gives the suffixes' order, so the longest Lyndon
words (next smaller suffix); each is extended to the right in the text's tree
and to the left in the reversal's, in constant time by the lowest common
ancestor over the Euler tour.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import blocks, release

#: Symbols that share a pair of trees; a longer stretch has trees of its own.
POOL_WORDS = 1 << 15
SPANS = "array<struct<start:long,length:long,period:long>>"


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (from 1) and a final 0 that is smaller than all others."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self.n = n = len(text)
        self.width = width = max(text) + 1
        starts, ends, links = [0], [0], [0]
        child: dict[int, int] = {}
        get = child.get
        node = edge = length = left = 0
        for i, symbol in enumerate(text):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = get(key)
                if below is None:
                    child[key] = len(starts)
                    starts.append(i)
                    ends.append(n)
                    links.append(0)
                    if last:
                        links[last] = node
                    last = node
                else:
                    at = starts[below]
                    size = min(ends[below], i + 1) - at
                    if length >= size:
                        node = below
                        edge += size
                        length -= size
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if last:
                            links[last] = node
                        break
                    middle = len(starts)
                    child[key] = middle
                    child[middle * width + text[at + length]] = below
                    child[middle * width + symbol] = middle + 1
                    starts += [at, i]
                    ends += [at + length, n]
                    links += [0, 0]
                    starts[below] = at + length
                    if last:
                        links[last] = middle
                    last = middle
                left -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._arrange(starts, ends, child)

    def _arrange(self, starts: list[int], ends: list[int], child: dict[int, int]) -> None:
        """Children of every node side by side, by symbol."""
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        parents = keys[order] // self.width
        self.below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        nodes = len(starts)
        self.first = np.searchsorted(parents, np.arange(nodes + 1)).tolist()
        self.sizes = (np.array(ends) - np.array(starts)).tolist()

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The Euler tour's levels and string depths, and each suffix's place on it."""
        first, below, sizes, n = self.first, self.below, self.sizes, self.n
        level, depth, place = [0], [0], [0] * n
        path = [(0, first[0])]
        at_level, at_depth = 0, 0
        while path:
            node, k = path[-1]
            if k == first[node + 1]:
                path.pop()
                if path:
                    at_level -= 1
                    at_depth -= sizes[node]
                    level.append(at_level)
                    depth.append(at_depth)
                continue
            path[-1] = (node, k + 1)
            lower = below[k]
            if first[lower] == first[lower + 1]:
                place[n - at_depth - sizes[lower]] = len(level)
                level += [at_level + 1, at_level]
                depth += [at_depth + sizes[lower], at_depth]
            else:
                path.append((lower, first[lower]))
                at_level += 1
                at_depth += sizes[lower]
                level.append(at_level)
                depth.append(at_depth)
        return np.array(level, np.int32), np.array(depth, np.int64), np.array(place, np.int64)

    def ranks(self, opposite: bool) -> list[int]:
        """Each suffix's rank; ``opposite`` turns the order of all symbols but the final one."""
        first, below, sizes, n = self.first, self.below, self.sizes, self.n
        rank, found = [0] * n, 0
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                rank[n - depth] = found
                found += 1
                continue
            lower = below[low:high]
            if not opposite:
                lower.reverse()
            elif sizes[lower[0]] == 1 and first[lower[0]] == first[lower[0] + 1]:
                # a leaf of one symbol has the final one, which stays the smallest
                lower.append(lower.pop(0))
            stack += [(c, depth + sizes[c]) for c in lower]
        return rank


def _block_table(size: int) -> np.ndarray:
    """For each pattern of steps in a block, the place of the least level from i to j."""
    patterns = np.arange(1 << (size - 1))
    steps = np.where((patterns[:, None] >> np.arange(size - 1)) & 1, 1, -1)
    levels = np.concatenate([np.zeros((len(patterns), 1), np.int64), np.cumsum(steps, axis=1)], axis=1)
    table = np.zeros((len(patterns), size, size), np.int8)
    for i in range(size):
        best = np.full(len(patterns), i)
        for j in range(i, size):
            less = levels[np.arange(len(patterns)), j] < levels[np.arange(len(patterns)), best]
            best = np.where(less, j, best)
            table[:, i, j] = best
    return table


class Extensions:
    """Longest common prefixes of suffixes: the depth of the lowest common ancestor of two leaves.

    Neighbours on the tour differ by one level, so a block is one of a few
    patterns whose answers are tabulated; a sparse table covers whole blocks.
    Space is linear, a query constant; queries run over arrays.
    """

    def __init__(self, tree: SuffixTree):
        levels, self.depth, self.place = tree.tour()
        m = len(levels)
        self.size = size = max(1, m.bit_length() // 2)
        count = -(-m // size)
        padded = np.concatenate([levels, levels[-1] + 1 + np.arange(count * size - m, dtype=np.int32)]).reshape(count, size)
        self.levels = padded.reshape(-1)
        self.pattern = ((np.diff(padded, axis=1) > 0) << np.arange(size - 1)).sum(axis=1).astype(np.int64)
        self.table = _block_table(size)
        least = np.arange(count) * size + self.table[self.pattern, 0, size - 1]
        self.rows = [least]
        width = 1
        while 2 * width <= count:
            before = self.rows[-1]
            a, b = before[: len(before) - width], before[width:]
            self.rows.append(np.where(self.levels[b] < self.levels[a], b, a))
            width *= 2

    def _lower(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.levels[b] < self.levels[a], b, a)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j (i != j), pair by pair."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        size = self.size
        x, y = a // size, b // size
        same = x == y
        left = x * size + self.table[self.pattern[x], a - x * size, np.where(same, b - x * size, size - 1)]
        right = y * size + self.table[self.pattern[y], np.where(same, a - y * size, 0), b - y * size]
        found = self._lower(left, right)
        inner = np.flatnonzero(y - x > 1)
        if len(inner):
            low, high = x[inner] + 1, y[inner] - 1
            power = np.frexp(high - low + 1)[1] - 1
            best = np.empty(len(inner), np.int64)
            for p in np.unique(power):
                at = np.flatnonzero(power == p)
                row = self.rows[p]
                best[at] = self._lower(row[low[at]], row[high[at] - (1 << int(p)) + 1])
            found[inner] = self._lower(found[inner], best)
        return self.depth[found]


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank: where its longest Lyndon word ends."""
    n = len(rank)
    found, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, np.int64)


def runs_of(symbols: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Every maximal run (start, length, smallest period) of at least ``least`` symbols and ``exponent`` periods (2 or more)."""
    n = len(symbols)
    if n < max(least, exponent):
        return []
    tree = SuffixTree(symbols)
    right = Extensions(tree)
    left = Extensions(SuffixTree(symbols[::-1]))
    found = []
    for opposite in (False, True):
        end = _next_smaller(tree.ranks(opposite)[:n])
        i = np.flatnonzero(end < n)
        j = end[i]
        ahead = right.common(i, j)
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        back[inner] = left.common(n - i[inner], n - j[inner])
        start, period = i - back, j - i
        length = j + ahead - start
        kept = (length >= least) & (length >= exponent * period)
        found.append(np.stack([start, length, period], axis=1)[kept])
    return [tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()]


def _repeated_windows(keys: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """True for the words inside a window of ``width`` words that its text holds twice or more (equal hashes count as equal)."""
    n = len(keys)
    covered = np.zeros(n + 1, np.int64)
    if n < width:
        return covered[:n] > 0
    hashed, have, factor = keys.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    while have < width:
        step = min(have, width - have)
        scale = np.uint64(pow(int(factor), step, 1 << 64))
        hashed = hashed[: len(hashed) - step] * scale + hashed[step:]
        have += step
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[: len(hashed)]
    inside = np.flatnonzero(np.arange(len(hashed)) + width <= np.repeat(bounds[1:], sizes)[: len(hashed)])
    hashed = (hashed ^ (text * np.uint64(0xD6E8FEB86659FD93)))[inside]
    order = np.argsort(hashed)
    equal = np.diff(hashed[order]) == 0
    twice = np.zeros(len(order), bool)
    twice[:-1] |= equal
    twice[1:] |= equal
    at = inside[order[twice]]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return np.cumsum(covered)[:n] > 0


def runs_of_texts(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words.

    A run of length L and period q holds each of its windows of L - q words
    twice, and L - q is at least ``least`` - ``least`` // ``exponent``. So every
    word of a run lies in a window of that width that its text repeats; the
    stretches of such words, one after another with symbols of their own in
    between, share a pair of trees. No run crosses such a symbol, none is lost.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    keys = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(bounds[-1]))
    inside = _repeated_windows(keys, bounds, max(1, least - least // exponent))
    # a stretch ends with its text as well
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    marks = np.unique(np.concatenate([first, bounds[:-1]]))
    marks = marks[marks < len(keys)]
    marks = marks[inside[marks]]
    edges = np.unique(np.concatenate([np.flatnonzero(~inside), bounds]))
    ends = edges[np.searchsorted(edges, marks, side="right")]
    owner = np.searchsorted(bounds, marks, side="right") - 1

    pool: list[tuple[int, int, int]] = []
    symbols: list[int] = []
    names: dict[bytes, int] = {}
    parts: list[list[bytes]] = []

    def flush() -> None:
        for words in parts:
            for w in words:
                names.setdefault(w, len(names) + 1)
        between = len(names)
        for words in parts:
            between += 1
            symbols.extend([names[w] for w in words])
            symbols.append(between)
        starts = np.cumsum([0, *(len(w) + 1 for w in parts)])
        for start, length, period in runs_of(symbols, least, exponent):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            text, offset, _ = pool[k]
            found[text].append((start - int(starts[k]) + offset, length, period))
        pool.clear()
        symbols.clear()
        names.clear()
        parts.clear()

    held = 0
    for text, low, high in zip(owner.tolist(), marks.tolist(), ends.tolist()):
        if high - low < least:
            continue
        offset = low - int(bounds[text])
        pool.append((text, offset, high - low))
        parts.append(texts[text][offset : offset + high - low])
        held += high - low
        if held >= POOL_WORDS:
            flush()
            held = 0
    if pool:
        flush()
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]


def find(
    docs: DataFrame,
    least: int = 24,
    exponent: int = 3,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Every periodic run of words in every whole text, and the text with each run cut to one period.

    A run is a stretch of words with smallest period q and a length of at least
    ``least`` and ``exponent`` * q that no neighbouring word extends. Words are
    cut at space and \\x09-\\x0D. ``prepare(doc_id, words)`` may give other
    words to work on. No shuffle: a task works through its rows in blocks of
    bytes; memory grows with the longest text, not with the table.

    Null and empty texts have no words and no runs; a null id is kept; repeated
    rows each give a row; extra columns are ignored; an empty table gives no rows.

    Returns ``doc_id, n_words, runs`` (by start, then period), ``collapsed``.
    """
    width = least - least // exponent
    if exponent < 2 or width < 1:
        raise ValueError("runs need two periods and two words or more")

    def run(batches):
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in blocks(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [raw.split() for raw in batch.column("text").to_pylist()]
            if prepare is not None:
                texts = [prepare(i, words) for i, words in zip(ids, texts)]
            runs = runs_of_texts(texts, least, exponent)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            kept = [b" ".join(collapsed(words, r)).decode("utf-8", "replace") for words, r in zip(texts, runs)]
            sizes = [len(words) for words in texts]
            del texts
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, spans), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )
        release()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, f"doc_id long, n_words long, runs {SPANS}, collapsed string"
    )


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with, for a tenth of the ids, everything from some place on repeating a few words (null id: as an empty number)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, ties to the first; null without a run."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def digest(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """``find`` on texts with periodic tails, as one strongest run and digests per row; see there for odd rows."""
    found = find(docs, least, exponent, periodic_tail).withColumn("best", strongest(F.col("runs")))
    lines = F.transform(
        "runs",
        lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
    )
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

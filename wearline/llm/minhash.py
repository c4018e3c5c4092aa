"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles, banded and verified."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import Carried, blocks, release, stored
from wearline.llm.graphs import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4
#: Words in a smaller share of the documents are joined, not broadcast, so at most 1000 x the mean number of distinct words are in memory.
LEAST_SHARE = 0.001
_COUNTED_WORDS = 200_000
_HUBS = 2
_NUMBER = 40
_SKETCHED_BYTES = 1 << 20
#: Shingles whose samples are drawn together, so that the arrays stay in the processor's cache.
_DRAWN = 1 << 14
_BLOCK, _COLUMNS = 256, 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between space and \\x09-\\x0D, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def _copy(own: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(own), digest_size=16).digest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _distinct(hashes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, ascending, their units (alike for equal hashes) and counts."""
    order = hashes.argsort()
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    if len(first) == len(hashes):
        return hashes, unit[order], np.ones(len(hashes), np.int64)
    return hashes[first], unit[order[first]], np.diff(np.append(first, len(hashes)))


class Sampler:
    """Weighted shingles of texts, their consistent weighted samples, and the weighted Jaccard similarity.

    A shingle's inverse document frequency is the sum of its words' (words taken
    as independent); its weight is its count in the text times that. For a
    weight w, sample k draws r and c from Gamma(2, 1) and b from the unit
    interval by the shingle's hash, takes t = floor(ln w / r + b), and keeps the
    shingle with the least ln c - r (t - b) - r. Two texts agree in (shingle, t)
    with the probability of their weighted Jaccard similarity.

    Frequent words' weights are in ``idf``; a text brings those of its other
    words as ``own``, and a word in neither weighs ``rare``.
    """

    def __init__(self, idf: dict[bytes, float], rare: float, samples: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.idf, self.rare = idf, rare
        self.seeds = draw.integers(1, 1 << 63, samples, dtype=np.uint64)
        self.r = draw.gamma(2, 1, 1 << 12)
        self.log_c = np.log(draw.gamma(2, 1, 1 << 16))

    def shingles(self, text: str, own: dict[bytes, float] = {}) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, ascending, and weights."""
        hashes, unit, count = self.counted(text, own)
        return hashes, unit * count

    def counted(self, text: str, own: dict[bytes, float] = {}) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, ascending, inverse document frequencies and counts. A text under five words is one shingle; one without words has none."""
        return self.counted_all([words(text)], own)[0]

    def counted_all(
        self, texts: list[list[bytes]], own: dict[bytes, float] = {}, rare: list[list[int] | None] = (), total: int = 0
    ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``counted`` of each text's words, laid end to end; shingles across two texts are left out.

        ``rare`` has word numbers and frequencies as ``_rare_words`` packs them. A
        word's frequency is that in all rows, so it weighs alike in all texts.
        """
        distinct = list(dict.fromkeys(chain.from_iterable(texts)))
        number = dict(zip(distinct, range(len(distinct))))
        sizes = [len(t) for t in texts]
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes).tolist()
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)[at]
        known = self.idf.get
        weight = np.array([known(w, math.nan) for w in distinct], dtype=np.float64)
        apart = np.isnan(weight)
        weight[apart] = [own.get(distinct[i], self.rare) for i in np.flatnonzero(apart).tolist()] if own else self.rare
        places, values, idf = [], [], {}
        for start, n, packed in zip(starts, sizes, rare):
            if packed:
                numbers = at[start : start + n]
                # as in ``_apart``
                names = list(dict.fromkeys(numbers[apart[numbers]].tolist()))
                places += [names[x >> _NUMBER] for x in packed]
                counts = [x & ((1 << _NUMBER) - 1) for x in packed]
                idf.update((c, _idf(total, c)) for c in counts if c not in idf)
                values += [idf[c] for c in counts]
        weight[np.array(places, np.int64)] = values
        weight = weight[at]
        whole, sums = self._joined(hashed, weight, WIDTH)
        found = []
        for start, n in zip(starts, sizes):
            if n >= WIDTH:
                part = slice(start, start + n - WIDTH + 1)
                found.append(_distinct(whole[part], sums[part]))
            elif n:
                found.append(_distinct(*self._joined(hashed[start : start + n], weight[start : start + n], n)))
            else:
                found.append((np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)))
        return found

    @staticmethod
    def _joined(hashed: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and summed weight of each ``width`` neighbours."""
        n = max(0, len(hashed) - width + 1)
        whole, sums = np.full(n, width, dtype=np.uint64), np.zeros(n)
        for k in range(width if n else 0):
            whole = (whole ^ hashed[k : k + n]) * _U(0x9E3779B97F4A7C15)
            whole ^= whole >> _U(29)
            sums += weight[k : k + n]
        return whole, sums

    def signatures(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of samples per non-empty set, as 64-bit hashes of (shingle, t)."""
        out, at = np.empty((len(sets), len(self.seeds)), dtype=np.uint64), 0
        while at < len(sets):
            end, total = at, 0
            while end < len(sets) and total < _DRAWN:
                total += len(sets[end][0])
                end += 1
            self._draw(sets[at:end], out[at:end])
            at = end
        return out

    def _draw(self, sets: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> None:
        sizes = np.array([len(h) for h, _ in sets])
        starts = np.cumsum(sizes) - sizes
        hashes, logs = np.concatenate([h for h, _ in sets]), np.log(np.concatenate([w for _, w in sets]))
        owner = np.repeat(np.arange(len(sets)), sizes)
        x, y = np.empty_like(hashes), np.empty_like(hashes)
        places = y.view(np.int64)
        a, b, r, t = (np.empty(len(hashes)) for _ in range(4))
        for k, seed in enumerate(self.seeds):
            np.bitwise_xor(hashes, seed, out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
                np.right_shift(x, _U(shift), out=y)
                x ^= y
                if factor:
                    x *= _U(factor)
            np.bitwise_and(x, _U(0xFFF), out=y)
            self.r.take(places, out=r, mode="clip")
            np.right_shift(x, _U(12), out=y)
            y &= _U(0xFFFFF)
            np.multiply(places, 2.0**-20, out=b)
            np.right_shift(x, _U(48), out=y)
            self.log_c.take(places, out=a, mode="clip")
            np.divide(logs, r, out=t)
            t += b
            np.floor(t, out=t)
            # a = ln c - r (t - b) - r
            np.subtract(t, b, out=b)
            b *= r
            a -= b
            a -= r
            np.minimum.reduceat(a, starts).take(owner, out=b, mode="clip")
            hit = np.flatnonzero(a == b)
            if len(hit) > len(sets):
                hit = hit[np.searchsorted(owner[hit], np.arange(len(sets)))]
            out[:, k] = _mix(hashes[hit] + t[hit].astype(np.int64).view(np.uint64) * _U(0xD6E8FEB86659FD93))

    @staticmethod
    def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
        """Sum of the smaller weights over the sum of the larger ones."""
        _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
        shared = np.minimum(one[1][i], other[1][j]).sum()
        total = one[1].sum() + other[1].sum() - shared
        return float(shared / total) if total else 0.0


def frequencies(docs: DataFrame) -> DataFrame:
    """``word, n``: the rows of ``docs`` that have it; the empty word counts all rows."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in blocks(batches):
            for text in batch.column("text").to_pylist():
                counts.update(set(words(text)))
                counts[b""] += 1
            if len(counts) > _COUNTED_WORDS:
                yield flush()
        if counts:
            yield flush()

    return stored(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _idf(total: int, n: int) -> float:
    return 1 + math.log(max(1, total) / n)


def _frequent(counted: DataFrame, samples: int, least_share: float) -> tuple[Sampler, int, float]:
    """The sampler of the words in at least a share of the rows, all rows, and that share of them."""
    total = (counted.filter(F.col("word") == F.lit(b"")).agg(F.max("n")).first()[0]) or 0
    least = max(1.0, least_share * total)
    rows = counted.filter(F.col("n") >= least).collect()
    return Sampler({bytes(w): _idf(total, n) for w, n in rows if bytes(w)}, _idf(total, 1), samples), total, least


def sampler_of(docs: DataFrame, samples: int = BANDS * ROWS, least_share: float = LEAST_SHARE) -> Sampler:
    """The sampler with the document frequencies of all rows of ``docs``; words under ``least_share`` come with the texts."""
    return _frequent(frequencies(docs), samples, least_share)[0]


def _apart(own: list[bytes], idf: dict[bytes, float]) -> list[bytes]:
    """The distinct ones of a text's words that are not broadcast, by first place."""
    return [w for w in dict.fromkeys(own) if w not in idf]


def _own(texts: list[str], rare: list[list[int] | None], sampler: Sampler, total: int) -> list[dict[bytes, float]]:
    """The weights each text brings; ``rare`` has word numbers and frequencies as ``_rare_words`` packs them."""
    out = []
    for text, packed in zip(texts, rare):
        names = _apart(words(text), sampler.idf) if packed else []
        out.append({names[x >> _NUMBER]: _idf(total, x & ((1 << _NUMBER) - 1)) for x in packed or ()})
    return out


def _with_key(texts: DataFrame) -> DataFrame:
    """With ``key``, by which a text finds the frequencies of its words."""
    return texts.withColumn("key", F.xxhash64("doc_id", "text"))


def _rare_words(texts: DataFrame, counted: DataFrame, shared, least: float) -> DataFrame:
    """``key, rare``: for each text's words that are not broadcast, but in two rows or more, the number in ``_apart`` and the rows that have it.

    They are joined by word with the stored counts; a word here is in fewer than
    ``least`` rows. A word without an entry is in one row. Both numbers share a long.
    """

    def run(batches):
        known = shared.value.idf
        for batch in blocks(batches):
            sizes, places, found = [], [], []
            for text in batch.column("text").to_pylist():
                own = _apart(words(text), known)
                sizes.append(len(own))
                places.append(np.arange(len(own)))
                found += own
            yield pa.record_batch([pa.array(np.repeat(batch.column("key").to_numpy(), sizes)), pa.array(np.concatenate(places)), pa.array(found, pa.binary())], names=["key", "at", "word"])

    pairs = texts.select("key", "text").mapInArrow(run, "key long, at long, word binary")
    met = pairs.join(counted.filter((F.col("n") > 1) & (F.col("n") < least)).hint("shuffle_hash"), "word")
    packed = met.select("key", (F.shiftleft("at", _NUMBER) + F.col("n")).alias("x"))
    return stored(packed.groupBy("key").agg(F.collect_set("x").alias("rare")))


def _sketched(rows: DataFrame, shared, total: int, bands: int) -> DataFrame:
    """``doc_id, copy`` (hash of the word sequence) and ``bands`` (null without words)."""

    def run(batches):
        sampler = shared.value
        for batch in blocks(batches, size=_SKETCHED_BYTES):
            texts = list(map(words, batch.column("text").to_pylist()))
            copies = list(map(_copy, texts))
            sets = [(h, unit * n) for h, unit, n in sampler.counted_all(texts, rare=batch.column("rare").to_pylist(), total=total)]
            full = [i for i, s in enumerate(sets) if len(s[0])]
            found: list[list[int] | None] = [None] * len(texts)
            if full:
                signature = sampler.signatures([sets[i] for i in full]).reshape(len(full), bands, -1)
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                for k in range(signature.shape[2]):
                    keys = _mix((keys ^ signature[:, :, k]) * _U(0x9E3779B97F4A7C15))
                keys = _mix(keys + np.arange(bands, dtype=np.uint64))
                for i, key in zip(full, keys.view(np.int64).tolist()):
                    found[i] = key
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(copies, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "copy", "bands"],
            )

    return rows.mapInArrow(run, "doc_id long, copy binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shared, total: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough. The text of a frequent ``b`` follows in a join that Spark can split."""

    def run(batches):
        sampler, last = shared.value, (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            one, other = batch.column("one").to_pylist(), batch.column("other").to_pylist()
            one_own, other_own = (_own(t, batch.column(c).to_pylist(), sampler, total) for t, c in ((one, "one_rare"), (other, "other_rare")))
            keep = []
            for i in range(len(a)):
                if last[0] != b[i]:
                    last = (b[i], sampler.shingles(other[i], other_own[i]))
                keep.append(sampler.similarity(sampler.shingles(one[i], one_own[i]), last[1]) >= similarity)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(id: str, name: str) -> DataFrame:
        return texts.select(F.col("id").alias(id), F.col("text").alias(name), F.col("rare").alias(f"{name}_rare")).hint("merge")

    both = pairs.join(side("a", "one"), "a").join(side("b", "other"), "b")
    return both.select("a", "b", *[f"{x}{c}" for x in ("one", "other") for c in ("", "_rare")]).mapInArrow(run, "a long, b long")


def _hub_pairs(rooted: DataFrame) -> DataFrame:
    """In each band value with several roots, the members of other roots against its hub.

    The hub is the member that shares most band values with others: in a group
    of near copies the text they were made from, if it is there. In a band value
    where the hub is not alone in its root, the hub of the other roots serves.
    """
    best = F.max_by(F.struct("id", "root"), F.struct("degree", -F.col("id")))
    first = rooted.groupBy("band").agg(
        best.alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")
    ).filter("low <> high").select("band", "hub")
    seen = rooted.join(first.hint("merge"), "band")
    joined = seen.groupBy("band").agg(F.sum((F.col("root") == F.col("hub.root")).cast("int")).alias("n")).filter("n > 1").select("band")
    second = seen.filter("root <> hub.root").join(joined, "band").groupBy("band").agg(best.alias("other"))
    chosen = first.join(second, "band", "left").select("band", F.coalesce("other", "hub").alias("hub"))
    hubs = rooted.join(chosen.hint("merge"), "band").filter("root <> hub.root")
    return hubs.select(F.col("id").alias("a"), F.col("hub.id").alias("b"))


def block_links(
    sampler: Sampler, texts: list[str], roots: list[int], sides: list[bool] | None, similarity: float, rare: list[list[int] | None] = (), total: int = 0
) -> list[tuple[int, int]]:
    """Links that join different roots, a spanning set of them, among the texts of one or two blocks.

    ``sides`` tells two blocks apart, of which only pairs across count. The
    weighted overlaps of all pairs are a product of matrices: a shingle that a
    text has n times is n columns. A pair close to the limit is measured again
    without the product's rounding.
    """
    sets = sampler.counted_all(list(map(words, texts)), rare=rare, total=total)
    weights = np.array([(u * n).sum() for _, u, n in sets])
    hashes, unit, count = (np.concatenate([s[i] for s in sets]) for i in range(3))
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    layer = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes, unit, owner = np.repeat(hashes, count), np.repeat(unit, count), np.repeat(owner, count)
    order = np.lexsort((layer, hashes))
    hashes, layer, unit, owner = hashes[order], layer[order], unit[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (layer[1:] != layer[:-1]))
    column = np.cumsum(new) - 1
    sizes = np.bincount(column)
    wide = sizes[column] > 1
    column, unit, owner = np.unique(column[wide], return_inverse=True)[1], unit[wide], owner[wide]
    overlap = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + _COLUMNS]))
        x = np.zeros((len(sets), _COLUMNS))
        x[owner[part], column[part] - at] = np.sqrt(unit[part])
        overlap += x @ x.T
    score = overlap / np.maximum(weights[:, None] + weights[None, :] - overlap, 1e-300)
    apart = np.array(roots)[:, None] != np.array(roots)[None, :]
    if sides is not None:
        apart &= np.array(sides)[:, None] != np.array(sides)[None, :]
    parent = {r: r for r in roots}

    def top(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    found = []
    for i, j in np.argwhere(np.triu(apart & (score > similarity - 1e-6), 1)).tolist():
        x, y = top(roots[i]), top(roots[j])
        if x == y:
            continue
        one, other = ((h, u * n) for h, u, n in (sets[i], sets[j]))
        if score[i, j] > similarity + 1e-6 or sampler.similarity(one, other) >= similarity:
            parent[max(x, y)] = min(x, y)
            found.append((i, j))
    return found


def _block_links(rooted: DataFrame, texts: DataFrame, shared, total: int, similarity: float) -> DataFrame:
    """Links between the roots of each band value that still has several, by pairs of blocks of its members.

    A task holds two blocks of ``_BLOCK`` members; it emits links that join
    roots, never its pairs.
    """
    spread = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    spread = spread.filter("low <> high").select("band", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks"))
    rows = rooted.join(spread, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "root")
    rows = rows.join(texts, "id")

    def compare(table: pa.Table) -> pa.Table:
        block, low, high = (table.column(c).to_pylist() for c in ("block", "low", "high"))
        sides = [b == low[0] for b in block] if low[0] != high[0] else None
        ids = table.column("id").to_pylist()
        texts, roots, rare = (table.column(c).to_pylist() for c in ("text", "root", "rare"))
        found = block_links(shared.value, texts, roots, sides, similarity, rare, total)
        release()
        pairs = [sorted((ids[i], ids[j])) for i, j in found]
        return pa.table({"a": pa.array([p[1] for p in pairs], pa.int64()), "b": pa.array([p[0] for p in pairs], pa.int64())})

    return rows.groupBy("band", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id`` for every row: the smallest id that links of at least ``similarity`` lead to.

    Texts with the same words are copies; one of each set of copies goes on. Two
    texts are candidates if they agree in a band of ``rows`` samples. In each
    band value every member is held against the value's hub, then those of other
    classes against a second hub. Band values that still have several classes
    are cut into blocks, and each pair of blocks is searched for further links
    between classes. So no link between classes is lost, and pairs are never
    rows. A link inside a class changes nothing and is not looked at.

    Every word weighs by its own document frequency over all rows: that of the
    words in a share of ``LEAST_SHARE`` is broadcast, the others' is joined.

    A text under five words is one shingle; texts without words (null, empty)
    are copies of each other. Rows without id have a null class. Each row has the
    class of its own text, also if its id stands for several; repeated rows each
    give a row. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = _with_key(texts)
    counted = frequencies(texts)
    sampler, total, least = _frequent(counted, bands * rows, LEAST_SHARE)
    shared = Carried(spark, sampler)
    weights = _rare_words(texts, counted, shared, least)
    sketched = stored(_sketched(texts.join(weights.hint("merge"), "key", "left"), shared, total, bands))
    copies = sketched.filter("doc_id IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("first"), F.min_by("bands", "doc_id").alias("bands"))
    copies = stored(copies.withColumn("id", F.monotonically_increasing_id()))
    members = copies.select("id", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = members.join(sizes, "band")
    hubs = members.groupBy("id").agg(F.sum("n").alias("degree"))
    members = stored(members.drop("n").join(hubs, "id"))
    # the text of each set of copies that meets another: of its first id, the one with those words
    meeting = copies.join(members.select("id").distinct(), "id").select("id", F.col("first").alias("doc_id"), "copy")

    def matching(batches):
        for batch in batches:
            same = [_copy(words(t)) == c for t, c in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist())]
            yield batch.select(["id", "text", "key"]).filter(pa.array(same, pa.bool_()))

    texts = texts.join(meeting, "doc_id").select("id", "copy", "text", "key").mapInArrow(matching, "id long, text string, key long")
    texts = texts.groupBy("id").agg(F.min(F.struct("text", "key")).alias("x")).select("id", "x.*")
    texts = stored(texts.join(weights.hint("merge"), "key", "left").select("id", "text", "rare"))
    rooted = members.withColumn("root", F.col("id"))
    links = None
    for _ in range(_HUBS):
        pairs = _hub_pairs(rooted).distinct()
        found = stored(_verified(pairs, texts, shared, total, similarity))
        links = found if links is None else stored(links.unionByName(found))
        rooted = stored(members.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id")))
    found = stored(_block_links(rooted, texts, shared, total, similarity))
    roots = components(links.unionByName(found))
    named = copies.join(roots, "id", "left").select("copy", "first", F.coalesce("root", "id").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(smallest, "root").select("copy", "class_id")
    return sketched.join(named, "copy", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest id of each class; rows without id stay, rows that repeat an id go together."""
    found = classes(docs, **options).filter("doc_id = class_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))

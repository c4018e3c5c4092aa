"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import Carried, blocks, remainder, text_of

PASSAGE_BYTES = 1024
SAMPLE_ROWS = 6000
SAMPLE_PASSAGES = 32
_AT_ONCE = 256
HIDDEN, ATTENTION = 24, 12

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|", b"#*$%&<>^~", b"\"'()[]{}-_/\\@=+`"]
_CLASSES = len(_GROUPS) + 2
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _class_table() -> np.ndarray:
    table = np.full(256, len(_GROUPS), dtype=np.uint8)
    table[128:] = len(_GROUPS) + 1
    for i, group in enumerate(_GROUPS):
        table[list(group)] = i
    return table


_TABLE = _class_table()
WIDTH = _CLASSES * _CLASSES + 3


def passages(text: str) -> np.ndarray:
    """One feature row per passage of ``PASSAGE_BYTES`` bytes; an empty text has one empty passage.

    Features: square roots of the shares of character-class pairs, the share of
    repeated 8-byte strings, the share of repeated 24-byte strings, and how full
    the passage is. Long texts are worked on in parts of ``_AT_ONCE`` passages.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    step = _AT_ONCE * PASSAGE_BYTES
    return np.concatenate([_features(data[at : at + step]) for at in range(0, max(1, len(data)), step)])


def _features(data: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(data) // PASSAGE_BYTES))
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if not len(data):
        return out
    kinds = _TABLE[data]
    pair = kinds[:-1].astype(np.int32) * _CLASSES + kinds[1:]
    owner = np.arange(len(pair)) // PASSAGE_BYTES
    counts = np.bincount(owner * (_CLASSES * _CLASSES) + pair, minlength=n * _CLASSES * _CLASSES)
    counts = counts.reshape(n, -1)
    out[:, : _CLASSES * _CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    padded = np.zeros(n * PASSAGE_BYTES, dtype=np.uint64)
    padded[: len(data)] = data
    rows = padded.reshape(n, PASSAGE_BYTES)
    sizes = np.minimum(PASSAGE_BYTES, len(data) - np.arange(n) * PASSAGE_BYTES)
    hashes = {1: rows}
    for width, left in ((2, 1), (4, 2), (8, 4), (16, 8), (24, 16)):
        n_at, right = PASSAGE_BYTES - width + 1, width - left
        joined = hashes[left][:, :n_at] * _ODD + hashes[right][:, left : left + n_at] * _OTHER
        hashes[width] = joined ^ (joined >> np.uint64(29))
    for column, width in ((-3, 8), (-2, 24)):
        at = np.arange(PASSAGE_BYTES - width + 1)
        own = np.where(at + width <= sizes[:, None], hashes[width] >> np.uint64(4), at.astype(np.uint64) + np.uint64(1 << 62))
        own.sort(axis=1)
        out[:, column] = (own[:, 1:] == own[:, :-1]).sum(1) / np.maximum(1, sizes)
    out[:, -1] = sizes / PASSAGE_BYTES
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """h = tanh(W x); weight softmax(w (tanh(V h) * sigmoid(U h))) within a document; score sigmoid(c z + d), z the weighted h."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        shape = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: draw.normal(0, 0.3 / np.sqrt(s[0]) if len(s) > 1 else 0.1, s) for k, s in shape.items()}
        self.p["b"][:] = 0
        self.p["d"][:] = 0
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x, starts):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, s, a, z, owner, _sigmoid(z @ p["c"] + p["d"])

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of each document; ``starts`` are the rows at which documents begin."""
        return self._forward((x - self.mean) / self.scale, starts)[-1]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, rate: float = 0.01, batch: int = 64, decay: float = 1e-4) -> AttentionModel:
        """Logistic loss, Adam, fixed order of shuffles. With no bags scores stay at one half, with one class near its share."""
        if not bags:
            self.p["c"][:] = 0
            return self
        every = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        share = np.clip(labels.mean(), 0.02, 0.98)
        self.p["d"][:] = np.log(share / (1 - share))
        draw, p = np.random.default_rng(11), self.p
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            for at in np.array_split(draw.permutation(len(bags)), max(1, len(bags) // batch)):
                x = np.concatenate([bags[i] for i in at])
                sizes = np.array([len(bags[i]) for i in at])
                starts = np.cumsum(sizes) - sizes
                h, t, s, a, z, owner, score = self._forward(x, starts)
                out = (score - labels[at]) / len(at)
                g = {"c": z.T @ out, "d": np.array([out.sum()])}
                dz = (out[:, None] * p["c"])[owner]
                da = (dz * h).sum(1)
                de = a * (da - np.add.reduceat(a * da, starts)[owner])
                g["w"] = (t * s).T @ de
                dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
                g["V"], g["U"] = h.T @ dt, h.T @ ds
                dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                g["W"], g["b"] = x.T @ dh, dh.sum(0)
                step += 1
                now = rate * (1 - epoch / epochs)
                for k in p:
                    grad = g[k] + decay * p[k]
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> AttentionModel:
    """The model of a bounded sample of labelled documents.

    Labels come only from ids whose crc32 modulo ``modulus`` is not ``held``;
    the ``sample_rows`` of them with the smallest hash of the id are used, of
    each at most ``SAMPLE_PASSAGES`` evenly spaced passages. An id with several
    labels has the smallest; null labels and ids are left out.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def features(batches):
        for batch in blocks(batches):
            bags = []
            for text in batch.column("text").to_pylist():
                bag = passages(text)
                if len(bag) > SAMPLE_PASSAGES:
                    bag = bag[np.linspace(0, len(bag) - 1, SAMPLE_PASSAGES).astype(int)]
                bags.append(bag.tobytes())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(features, "doc_id long, quality int, bag binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, WIDTH) for r in found]
    return AttentionModel().fit(bags, np.array([float(r["quality"]) for r in found]))


def score(docs: DataFrame, model: AttentionModel, threshold: float = 0.7, modulus: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, in place: no shuffle.

    All passages of a text count. Null and empty texts are scored as one empty
    passage; repeated rows have equal scores; extra columns are ignored; an
    empty table gives no rows.
    """
    shared = Carried(docs.sparkSession, model)

    def run(batches):
        for batch in blocks(batches):
            bags = [passages(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(b) for b in bags])
            scores = shared.value.scores(np.concatenate(bags), np.cumsum(sizes) - sizes)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = text_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder("doc_id", modulus) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AttentionModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    shared = Carried(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept = []
            for i in range(0, len(texts), 256):
                bags = [passages(t or "") for t in texts[i : i + 256]]
                sizes = np.array([len(b) for b in bags])
                kept.append(shared.value.scores(np.concatenate(bags), np.cumsum(sizes) - sizes) >= threshold)
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)

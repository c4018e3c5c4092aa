"""Token-id shards as wavelet matrices: succinct bit planes with rank and select in one compressed payload each."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import blocks, stored, text_of
from wearline.llm.tokens import encoder

SHARD_TOKENS = 1 << 20
_MAGIC = b"WMT1"
_WORD = 512  # bits between rank samples

SHARD_SCHEMA = "partition int, shard int, local_start long, n_tokens long, payload binary"
DOC_SCHEMA = "doc_id long, partition int, local_start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Sequence of token ids as one bit plane per bit, the highest first, zeros before ones on each level.

    ``access``, ``rank``, ``select`` and ``count`` read the planes without
    decoding them; ``decode`` gives all ids.
    """

    def __init__(self, size: int, planes: list[np.ndarray]):
        self.size, self.planes = size, planes
        self.zeros = [size - int(np.bitwise_count(p).sum()) for p in planes]
        self._samples: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        level = np.ascontiguousarray(ids)
        depth = max(1, int(level.max(initial=0)).bit_length())
        planes = []
        for shift in range(depth - 1, -1, -1):
            bits = (level >> shift) & 1 != 0
            planes.append(np.packbits(bits, bitorder="little"))
            level = np.concatenate([level[~bits], level[bits]])
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        level = np.zeros(self.size, dtype=kind)
        for shift, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bits = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            above = np.empty(self.size, dtype=kind)
            above[~bits] = level[:zeros]
            above[bits] = level[zeros:] | kind(1 << shift)
            level = above
        return level

    def _ones(self, level: int, at: int) -> int:
        """Set bits of a plane before position ``at``."""
        if self._samples is None:
            step = _WORD // 8
            self._samples = [
                np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), step), dtype=np.int64))])
                if len(p)
                else np.zeros(1, np.int64)
                for p in self.planes
            ]
        word = at // _WORD
        first, plane = word * (_WORD // 8), self.planes[level]
        ones = int(self._samples[level][word]) + int(np.bitwise_count(plane[first : at // 8]).sum())
        if at % 8:
            ones += (int(plane[at // 8]) & ((1 << at % 8) - 1)).bit_count()
        return ones

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at // 8]) >> at % 8 & 1
            ones = self._ones(level, at)
            value, at = value << 1 | bit, zeros + ones if bit else at - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        if token >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (len(self.planes) - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``token``."""
        low, high = self._range(token, self.size)
        if not 0 <= k < high - low:
            raise IndexError(f"token {token} occurs {high - low} times")
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            target = at - self.zeros[level] if bit else at
            left, right = 0, self.size
            while left < right:
                mid = (left + right) // 2
                ones = self._ones(level, mid + 1)
                if (ones if bit else mid + 1 - ones) <= target:
                    left = mid + 1
                else:
                    right = mid
            at = left
        return at


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: magic, sizes, compressed index of documents, compressed planes. A null id is stored beside a flag."""
    matrix = WaveletMatrix.build(ids)
    index = np.array([[d is None, d or 0, n] for d, n in zip(doc_ids, lengths)], dtype="<i8").reshape(-1, 3)
    index[1:, 1] = np.diff(index[:, 1])
    index = zlib.compress(index.T.tobytes(), 1)
    planes = zlib.compress(b"".join(p.tobytes() for p in matrix.planes), 1)
    head = struct.pack("<4sQQQQ", _MAGIC, len(lengths), matrix.size, len(matrix.planes), len(index))
    return head + index + planes


def read_shard(payload: bytes) -> tuple[list[int | None], list[int], WaveletMatrix]:
    magic, documents, size, depth, index_bytes = struct.unpack_from("<4sQQQQ", payload)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sQQQQ")
    index = np.frombuffer(zlib.decompress(payload[at : at + index_bytes]), dtype="<i8").reshape(3, documents)
    raw = np.frombuffer(zlib.decompress(payload[at + index_bytes :]), dtype=np.uint8)
    width = -(-size // 8)
    planes = [raw[i * width : (i + 1) * width] for i in range(depth)]
    names = np.cumsum(index[1]).tolist()
    return [None if f else d for f, d in zip(index[0].tolist(), names)], index[2].tolist(), WaveletMatrix(size, planes)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Token shards of ``docs`` in ascending id order, stored in the shared folder; one row is one file.

    Documents are range-partitioned by id, so a partition's shards follow those
    of the partition before it. Each document's ids (null or empty text: none)
    end with ``end_id``. A shard closes at the first document end past
    ``shard_tokens``. Rows with the same id are ordered by text; a null id
    comes first. An empty table gives no shard.

    Returns ``partition, shard, local_start, n_tokens, payload``; ``local_start``
    counts the ids before the shard in its partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = text_of(docs).repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def shards(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        partition, shard, before = TaskContext.get().partitionId(), 0, 0
        names, lengths, kept, held = [], [], [], 0
        end = np.array([end_id], encode.dtype).tobytes()

        def close():
            payload = write_shard(names, lengths, np.frombuffer(b"".join(kept), encode.dtype))
            return pa.record_batch(
                [pa.array([v], t) for v, t in zip((partition, shard, before, held, payload), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["partition", "shard", "local_start", "n_tokens", "payload"],
            )

        for batch in blocks(batches):
            for name, ids in zip(batch.column("doc_id").to_pylist(), encode.ids(batch.column("text").to_pylist())):
                n = len(ids) // encode.dtype.itemsize + 1
                names.append(name)
                lengths.append(n)
                kept += [ids, end]
                held += n
                if held >= shard_tokens:
                    yield close()
                    shard, before = shard + 1, before + held
                    names, lengths, kept, held = [], [], [], 0
        if names:
            yield close()

    return stored(rows.mapInArrow(shards, SHARD_SCHEMA))


def read(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards' payloads.

    A partition's first position is the sum over the partitions before it: one
    row per partition reaches the driver, not one per shard or document.
    """

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                names, lengths, matrix = read_shard(one.column("payload")[0].as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.record_batch(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(np.full(len(names), one.column("partition")[0].as_py(), np.int32)),
                        pa.array(starts + one.column("local_start")[0].as_py(), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    ],
                    names=["doc_id", "partition", "local_start", "n_tokens", "ids_crc32"],
                )

    totals = {r[0]: r[1] for r in shards.groupBy("partition").agg(F.sum("n_tokens")).collect()}
    starts, total = [], 0
    for partition in range(max(totals, default=-1) + 1):
        starts.append(total)
        total += totals.get(partition, 0)
    first = F.array(*[F.lit(s).cast("long") for s in starts]) if starts else F.array(F.lit(0).cast("long"))
    rows = shards.select("partition", "local_start", "payload").mapInArrow(documents, DOC_SCHEMA)
    return rows.select("doc_id", (F.get(first, F.col("partition")) + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

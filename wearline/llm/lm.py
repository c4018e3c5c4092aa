"""Document probability under a subword lattice: all segmentations of a fixed piece vocabulary, summed."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import Carried, blocks, per_worker, remainder, stored, text_of

#: A word kept in memory with its scores makes up at least this share of the training tokens, so there are at most 200,000.
COMMON_SHARE = 5e-6
_COUNTED_WORDS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARK = "▁"


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased; bytes.split() cuts at space and \\x09-\\x0D only."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


class Pieces:
    """The vocabulary file's pieces: normal ones by text, byte pieces by value."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.size = m.get_piece_size()
        ids = range(self.size)
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.normal = {m.id_to_piece(i): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}

    def segment(self, word: str) -> list[int]:
        return self.model.encode(word, out_type=int)


def pieces(path: str) -> Pieces:
    return per_worker(f"pieces:{path}", lambda: Pieces(path))


class Lattice:
    """Unigram scores of the pieces and the forward recursion over them.

    ``log_marginal(word)`` is the natural logarithm of the sum, over all
    segmentations of the marked word into normal and byte pieces, of the product
    of the pieces' probabilities. A character's bytes are one arc.
    """

    def __init__(self, vocabulary: Pieces, counts: dict[int, int], ends: int):
        total = sum(counts.values()) + ends + len(vocabulary.normal) + len(vocabulary.bytes) + 1
        self.end = math.log((ends + 1) / total)
        self.byte = {b: math.log((counts.get(i, 0) + 1) / total) for b, i in vocabulary.bytes.items()}
        self.table: dict[str, float | None] = {}
        for piece, i in vocabulary.normal.items():
            for n in range(1, len(piece)):
                self.table.setdefault(piece[:n], None)
            self.table[piece] = math.log((counts.get(i, 0) + 1) / total)
        self.spelled: dict[str, float] = {}

    def _bytes(self, char: str) -> float:
        if char not in self.spelled:
            if len(self.spelled) > 100_000:
                self.spelled.clear()
            self.spelled[char] = sum(self.byte[b] for b in char.encode("utf-8", "replace"))
        return self.spelled[char]

    def log_marginal(self, word: str) -> float:
        text, table, log, exp = _MARK + word, self.table, math.log, math.exp
        n = len(text)
        arriving: list[list[float] | None] = [[] for _ in range(n + 1)]
        arriving[0] = [0.0]
        forward = 0.0
        for i in range(n + 1):
            terms = arriving[i]
            arriving[i] = None
            most = max(terms)
            forward = most if len(terms) == 1 else most + log(sum([exp(t - most) for t in terms]))
            if i == n:
                break
            arriving[i + 1].append(forward + self._bytes(text[i]))
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if part not in table:
                    break
                p = table[part]
                if p is not None:
                    arriving[j].append(forward + p)
        return forward


def _count_words(docs: DataFrame) -> DataFrame:
    """``word, c``: occurrences in training rows of every word of any row; each task sums before the shuffle."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in blocks(batches):
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                if held:
                    for w in words(text):
                        counts[w] += 0
                else:
                    counts.update(words(text))
            if len(counts) > _COUNTED_WORDS:
                yield flush()
        if counts:
            yield flush()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _count_pieces(counted: DataFrame, path: str) -> dict[int, int]:
    """How often each piece occurs in the training words, cut as the vocabulary's own model cuts them; one row per piece."""

    def run(batches):
        vocabulary, counts = pieces(path), Counter()
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                for i in vocabulary.segment(word.decode("utf-8", "replace")):
                    counts[i] += c
        yield pa.record_batch([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["piece", "c"])

    rows = counted.filter("c > 0").mapInArrow(run, "piece long, c long")
    return {r[0]: r[1] for r in rows.groupBy("piece").agg(F.sum("c")).collect()}


def score(docs: DataFrame, pieces_path: str, modulus: int = 7, held: int = 2, common_share: float = COMMON_SHARE) -> DataFrame:
    """Word score and lattice score of every whole text.

    Training rows are those whose crc32 of the id modulo ``modulus`` is not
    ``held``. The piece vocabulary is a given file; its scores are the relative
    frequencies (plus one) of the pieces in the training words. Pieces never
    cross words, so a text's marginal is the product of its words' marginals and
    the end's probability; each distinct word runs through the lattice once.

    Words that make up at least ``common_share`` of the training tokens (at most
    1 / share words) are looked up in memory; all other words of a document are
    joined with the word table, so no join key is frequent.

    Null and empty texts have the end token only; repeated rows each give a row;
    extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = text_of(docs).select(
        "doc_id", "text", (remainder("doc_id", modulus) == held).alias("held_out"), F.xxhash64("doc_id", "text").alias("key")
    )
    counted = stored(_count_words(rows))
    known = counted.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = rows.filter("NOT held_out").count()
    total, distinct = known[0] + ends, known[1] + (ends > 0)
    lattice = Carried(spark, Lattice(pieces(pieces_path), _count_pieces(counted, pieces_path), ends))
    unit = math.log(10)

    def marginals(batches):
        model = lattice.value
        for batch in batches:
            logs = [model.log_marginal(w.decode("utf-8", "replace")) / unit for w in batch.column("word").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(logs, pa.float64())], names=["word", "c", "lattice"])

    table = stored(counted.mapInArrow(marginals, "word binary, c long, lattice double"))
    base = {"n": total + distinct + 1}
    common_rows = table.filter(F.col("c") >= max(1, math.ceil(total * common_share))).collect()
    common = spark.sparkContext.broadcast({bytes(r[0]): (r[1] > 0, math.log10((r[1] + 1) / base["n"]), r[2]) for r in common_rows})
    end_base, end_score = math.log10((ends + 1) / base["n"]), lattice.value.end / unit

    def scored(batches):
        seen = common.value
        for batch in blocks(batches):
            out = []
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                n_known, plain, marginal, rest = int(ends > 0), end_base, end_score, []
                for word, n in Counter(tokens).items():
                    hit = seen.get(word)
                    if hit is None:
                        rest.append({"word": word, "tf": n})
                    else:
                        n_known += n * hit[0]
                        plain += n * hit[1]
                        marginal += n * hit[2]
                out.append((len(tokens) + 1, n_known, plain, marginal, rest))
            columns = list(zip(*out))
            rare = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "held_out", "key", "n_tokens", "n_known", "base", "lattice", "rare"],
            )

    schema = "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base double, lattice double, rare array<struct<word:binary,tf:long>>"
    parts = rows.select("doc_id", "held_out", "key", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scored, schema)
    parts = parts.select("*", F.posexplode_outer("rare").alias("at", "hit")).drop("rare")
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    parts = parts.select(
        "doc_id",
        "held_out",
        "key",
        first.cast("long").alias("copies"),
        *[F.when(first, F.col(c)).otherwise(0).alias(c) for c in ("n_tokens", "n_known", "base", "lattice")],
        # a row without a rare word gets a key that no word has
        F.coalesce(F.col("hit.word"), F.concat(F.lit(" "), F.col("key").cast("string")).cast("binary")).alias("word"),
        F.coalesce(F.col("hit.tf"), F.lit(0)).alias("tf"),
    )
    found = table.select("word", "c", F.col("lattice").alias("word_lattice"))
    joined = parts.join(found.hint("shuffle_hash"), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = joined.groupBy("doc_id", "held_out", "key").agg(
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("tf") * F.log10((c + 1) / F.lit(float(base["n"])))).alias("base"),
        F.sum(F.col("lattice") + F.col("tf") * F.coalesce(F.col("word_lattice"), F.lit(0.0))).alias("lattice"),
    )
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return sums.select(
        "doc_id",
        "held_out",
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("lattice") / F.col("copies")).alias("score"),
    )

"""Byte-pair encoding by a pair occurrence index over a partition's new pre-tokens, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from wearline.llm.common import blocks, per_worker, text_of
from wearline.llm.tokens import BYTE_LEVEL, byte_alphabet

KEPT_WORDS = 500_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairIndexBpe:
    """Byte-level BPE of a vocabulary file (merges in rank order).

    ``learn`` lays the symbols of all new pre-tokens of a block end to end, maps
    each pair of neighbours to all its positions, and applies the active ranks
    in ascending order: every position of the pair is merged from left to right
    and the lists of the pairs left and right of it are updated. A position
    whose pair has changed meanwhile is skipped.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        self.rank, self.merged = {}, []
        for rank, (left, right) in enumerate(content["model"]["merges"]):
            self.rank.setdefault((vocabulary[left], vocabulary[right]), rank)
            self.merged.append(vocabulary[left + right])
        alphabet = byte_alphabet()
        self.byte_ids = [vocabulary[alphabet[b]] for b in range(256)]
        byte_of = {c: b for b, c in alphabet.items()}
        self.bytes_of = [b""] * (max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of += [b""] * (i + 1 - len(self.bytes_of))
            self.bytes_of[i] = token.encode()
        ordered = sorted(self.special, key=len, reverse=True)
        self.sections = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.pretokens = regex.compile(BYTE_LEVEL).findall
        self.known: dict[str, tuple[str, bytes]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode the words together; keeps each one's ids and the bytes they decode to."""
        symbols, starts = [], []
        for word in words:
            starts.append(len(symbols))
            symbols += [self.byte_ids[b] for b in word.encode()]
            symbols.append(-1)
        n, rank, merged = len(symbols), self.rank, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in index:
                index[pair].append(i)
            elif pair in rank:
                index[pair] = [i]
        active = [(rank[pair], pair) for pair in index]
        heapq.heapify(active)
        while active:
            number, pair = heapq.heappop(active)
            left, right = pair
            new = merged[number]
            for i in sorted(index.pop(pair)):
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue
                k, h = after[j], before[i]
                symbols[i], symbols[j] = new, -2
                after[i] = k
                if k < n:
                    before[k] = i
                    self._note(index, active, (new, symbols[k]), i)
                if h >= 0:
                    self._note(index, active, (symbols[h], new), h)
        table = self.bytes_of
        for word, start in zip(words, starts):
            ids, i = [], start
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            self.known[word] = (",".join(map(str, ids)), b"".join([table[x] for x in ids]))

    def _note(self, index, active, pair, position) -> None:
        held = index.get(pair)
        if held is not None:
            held.append(position)
        elif pair in self.rank:
            index[pair] = [position]
            heapq.heappush(active, (self.rank[pair], pair))

    def words(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if self.sections is None or not any(s in text for s in self.special):
            return self.pretokens(text)
        found = []
        for section in self.sections.split(text):
            found += [section] if section in self.special else self.pretokens(section)
        return found

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, as decimals joined by commas, and the bytes they stand for."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if not self.known:
            self.known.update({s: (str(i), s.encode()) for s, i in self.special.items()})
        split = [self.words(t) for t in texts]
        known = self.known
        self.learn([w for w in dict.fromkeys(w for words in split for w in words) if w not in known])
        found = []
        for words in split:
            parts = [known[w] for w in words]
            found.append((",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        return found

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, special tokens stay."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def codec(path: str) -> PairIndexBpe:
    return per_worker(f"bpe:{path}", lambda: PairIndexBpe(path))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` with the token ids of every whole text (null or empty text: no id)."""

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in blocks(batches):
            found = bpe.encode(batch.column("text").to_pylist())
            ids = [[int(x) for x in i.split(",")] if i else [] for i, _ in found]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``ids``; null ids give an empty text."""

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document the number of ids, the hash of the ids and that of the text decoded from them.

    Each row gives one row, in place: no shuffle. Null texts count as empty
    (no ids); repeated rows give equal rows; extra columns are ignored; an empty
    table gives no rows. Long texts are cut only into pre-tokens.
    """

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in blocks(batches):
            found = bpe.encode(batch.column("text").to_pylist())
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([i.count(",") + 1 if i else 0 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in found]),
                    pa.array([hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for _, b in found]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return text_of(docs).mapInArrow(run, SCHEMA)

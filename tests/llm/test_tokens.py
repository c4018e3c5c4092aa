import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import odd_rows, table
from wearline.llm import bpe, packing, tokenfile
from wearline.llm.tokens import ChunkEncoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def reference(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def hostile(n=3000, seed=4):
    draw = np.random.default_rng(seed)
    parts = [" ", "\n", "\t", "a", "b", " ", "é", "'s", "1", "!", "<|endoftext|>", "ſ", "\x1c", "́", "漢", "A", "\x00", "İ"]
    return ["".join(draw.choice(parts, size=draw.integers(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunk_encoder_equals_library(path):
    encoder, library = ChunkEncoder(path), Tokenizer.from_file(path)
    texts = hostile() + [r[1] or "" for r in odd_rows()]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.ids(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_marks_accents_and_line_ends_share_a_words_ids(path, monkeypatch):
    encoder = ChunkEncoder(path)
    encoder.ids(["seen *** ,. ."])
    split, asked = encoder.pretokens, []
    monkeypatch.setattr(encoder, "pretokens", lambda text: asked.append(text) or split(text))
    text = "Été seen, Été*** Été,.\nseen.\nÉté Été\nseen"
    ids = np.frombuffer(encoder.ids([text])[0], encoder.dtype).tolist()
    assert ids == reference(path, text)
    assert not [x for x in asked if any(c.isalpha() for c in x)]


def test_pair_index_equals_library():
    codec, library = bpe.PairIndexBpe(BYTES), Tokenizer.from_file(BYTES)
    texts = hostile(seed=5) + [r[1] or "" for r in odd_rows()]
    for text, (ids, raw) in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want))
        assert raw.decode("utf-8", "replace") == codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_digest(spark):
    rows = odd_rows()
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(table(spark, rows), BYTES).collect())
    want = []
    for doc, text, *_ in rows:
        ids = reference(BYTES, text)
        want.append((str(doc), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)
    assert bpe.digest(table(spark, []), BYTES).collect() == []


def test_bpe_round_trip(spark):
    df = table(spark, odd_rows())
    back = bpe.decode(bpe.encode(df, BYTES), BYTES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, *_ in odd_rows())


def test_wavelet_matrix():
    draw = np.random.default_rng(2)
    for size, top in ((0, 5), (1, 1), (7, 2), (1500, 50_000), (5000, 3), (600, 100_000)):
        ids = draw.integers(0, top, size).astype(np.uint32)
        matrix = tokenfile.WaveletMatrix.build(ids)
        assert matrix.decode().tolist() == ids.tolist()
        for at in range(0, size, 97):
            assert matrix.access(at) == ids[at]
            token = int(ids[at])
            assert matrix.rank(token, at) == (ids[:at] == token).sum()
            assert matrix.select(token, matrix.rank(token, at)) == at
        assert matrix.count(top + 70_000) == 0
        with pytest.raises(IndexError):
            matrix.select(1, size + 1)


def test_shard_round_trip():
    ids = np.arange(10, dtype=np.uint16)
    names, lengths, matrix = tokenfile.read_shard(tokenfile.write_shard([None, -4, 9], [1, 4, 5], ids))
    assert (names, lengths, matrix.decode().tolist()) == ([None, -4, 9], [1, 4, 5], ids.tolist())
    with pytest.raises(ValueError):
        tokenfile.read_shard(b"x" * 60)


@pytest.mark.parametrize("shard_tokens", [1, 500, 1 << 20])
def test_token_shards(spark, shard_tokens):
    rows = odd_rows()
    found = tokenfile.read(tokenfile.write(table(spark, rows), WORDS, shard_tokens=shard_tokens)).collect()
    start, want = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = reference(WORDS, text) + [1]
        want.append((str(doc), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in found) == sorted(want)
    assert tokenfile.read(tokenfile.write(table(spark, []), WORDS)).collect() == []


@pytest.mark.parametrize("window, shard_tokens", [(2048, 1 << 19), (64, 400)])
def test_packing(spark, window, shard_tokens):
    rows = odd_rows()
    pieces = packing.pack(table(spark, rows), BYTES, window=window, shard_tokens=shard_tokens).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or at & (at - 1) == 0
    for doc in {r[0] for r in rows}:
        texts = [r[1] for r in rows if r[0] == doc]
        ids = reference(BYTES, texts[0]) + [1]
        covered = [0] * len(ids)
        for p in documents[doc]:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            for i in range(p.start, p.start + p.length):
                covered[i] += 1
        assert covered == [len(texts)] * len(ids)
    assert packing.pack(table(spark, []), BYTES).collect() == []


def test_packing_puts_like_texts_together():
    idf = np.full(100, 1.0)
    tails = [np.array(t, np.uint16) for t in ([1, 2, 3, 4], [50, 51, 52, 53], [1, 2, 3, 5], [50, 51, 52, 54])]
    sequences = packing.pack_shard(tails, idf, 8)
    assert [sorted(i for i, _, _ in s) for s in sequences] == [[0, 2], [1, 3]]

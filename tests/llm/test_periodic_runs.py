import hashlib
import random
import zlib

import pytest

from tests.llm.helpers import odd_rows, table
from wearline.llm import runs


def brute_runs(words, least, exponent):
    """Every maximal stretch with period q, for each q; kept if no smaller period holds."""
    n, found = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, exponent * q):
                part = words[start : start + length]
                if all(any(part[k] != part[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.add((start, length, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(draw, n, kinds):
    words = [draw.randint(1, kinds) for _ in range(n)]
    if n and draw.random() < 0.5:
        part = [draw.randint(1, kinds) for _ in range(draw.randint(1, 12))]
        at = draw.randrange(n)
        words[at:] = (part * n)[: n - at]
    return words


@pytest.mark.parametrize("least,exponent", [(4, 2), (6, 3), (1, 2), (9, 4)])
def test_runs_of_words_equal_brute_force(least, exponent):
    draw = random.Random(least)
    for _ in range(400):
        words = periodic_words(draw, draw.randint(0, 60), draw.choice([1, 2, 2, 3, 6]))
        assert sorted(runs.runs_of(words, least, exponent)) == sorted(brute_runs(words, least, exponent)), words


def test_runs_of_texts_equal_brute_force(monkeypatch):
    draw = random.Random(3)
    for pool in (1, 100, 1 << 15):
        monkeypatch.setattr(runs, "POOL_WORDS", pool)
        for _ in range(60):
            texts = [periodic_words(draw, draw.randint(0, 150), draw.choice([2, 3, 50])) for _ in range(draw.randint(0, 6))]
            found = runs.runs_of_texts([[str(w).encode() for w in t] for t in texts], 24, 3)
            assert found == [brute_runs(t, 24, 3) for t in texts]


def test_longest_common_extensions():
    draw = random.Random(5)
    for n, kinds in ((1, 1), (2, 1), (7, 2), (80, 2), (300, 1), (300, 3)):
        word = [draw.randint(1, kinds) for _ in range(n)]
        lce = runs.Extensions(runs.SuffixTree(word))
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        if not pairs:
            continue
        got = lce.common(*(runs.np.array(c) for c in zip(*pairs)))
        for (i, j), length in zip(pairs, got.tolist()):
            want = 0
            while max(i, j) + want < n and word[i + want] == word[j + want]:
                want += 1
            assert length == want


def test_suffix_order_both_ways():
    draw = random.Random(6)
    for _ in range(100):
        word = [draw.randint(1, 4) for _ in range(draw.randint(1, 40))]
        tree = runs.SuffixTree(word)
        for opposite in (False, True):
            signed = [-w if opposite else w for w in word]
            order = sorted(range(len(word) + 1), key=lambda i: signed[i:])
            assert tree.ranks(opposite) == [order.index(i) for i in range(len(word) + 1)]


def brute_digest(rows):
    out = []
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words, 24, 3)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc, len(found), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_digest(spark):
    draw = random.Random(9)
    rows = [(d, " ".join(t.split()[:400]) if d == 23 else t) for d, t, *_ in odd_rows()]
    rows += [(100 + i, " ".join(map(str, periodic_words(draw, draw.randint(20, 120), draw.choice([2, 3, 40]))))) for i in range(60)]
    rows += [(200, "a " * 30), (201, "a " * 23), (202, "a b " * 12), (203, " ".join(["x y z w v u t s r"] * 3)), (203, "a " * 30)]
    rows += [(204, "\x1c".join(["a\x85b"] * 40)), (205, "\x0b".join(["é 漢"] * 40))]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = runs.digest(table(spark, rows)).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_digest(rows)
    assert sum(r.n_runs for r in got) >= 25
    assert runs.digest(table(spark, [])).collect() == []


def test_strongest_run_is_exact(spark):
    df = spark.createDataFrame([([(0, 30, 7), (3, 60, 14), (5, 31, 7), (9, 62, 14)],)], f"runs {runs.SPANS}")
    assert tuple(df.select(runs.strongest(df.runs).alias("b")).first().b) == (5, 31, 7)


def test_long_text_of_one_word(spark):
    rows = [(1, "a " * 120_000), (2, "a b c " * 40_000)]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(table(spark, rows)).collect()}
    assert got == {1: (120_000, [(0, 120_000, 1)], "a"), 2: (120_000, [(0, 120_000, 3)], "a b c")}

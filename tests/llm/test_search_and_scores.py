import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import odd_rows, table
from wearline.llm import classifier, lm, topk

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_topk(rows, queries, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in v))
    best = {}
    for q in queries:
        for a in usable.get(q, ()):
            for i, vectors in usable.items():
                if i != q:
                    for b in vectors:
                        score = sum(x * y for x, y in zip(a, b))
                        best[q, i] = max(score, best.get((q, i), score))
    found = []
    for q in queries:
        own = sorted(((-s, i) for (a, i), s in best.items() if a == q))[:k]
        found += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(own)]
    return sorted(found)


@pytest.mark.parametrize("block_rows, query_rows", [(8192, 2048), (7, 3)])
def test_topk(spark, monkeypatch, block_rows, query_rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", query_rows)
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.choice([0, 0, 0.5, -0.25, 1.75], 6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 1.0]), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (64, []), (65, [1.0] * 9), (None, [1.0] * 6)]
    rows += [rows[0], rows[7], (10, [1.75] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS q", "3 AS id", "4 AS v")
    found = topk.search(df.filter("vec_id % 5 = 0"), df, k=5).collect()
    assert sorted(tuple(r) for r in found) == brute_topk(rows, [i for i in range(0, 66, 5)], 5)
    assert topk.search(df.limit(0), df).collect() == [] == topk.search(df, df.limit(0)).collect()


def test_topk_large_numbers(spark):
    rows = [(0, [3e15, 1.0]), (1, [3e15, -1.0]), (2, [0.0, 5.0])]
    scores = [r.score for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[2:], "vec_id long, embedding array<double>")).collect()]
    assert sorted(scores) == [256 * -1280, 256 * 1280]


def test_lattice_sums_all_segmentations():
    pieces = lm.pieces(PIECES)
    model = lm.Lattice(pieces, {pieces.normal[p]: n for p, n in {"▁the": 50, "▁t": 9, "he": 20, "▁": 5, "th": 7}.items()}, 3)
    for word in ("the", "thé", "x", "漢", "hehe"):
        text = "▁" + word

        def total(rest):
            if not rest:
                return 1.0
            byte = math.exp(sum(model.byte[b] for b in rest[0].encode()))
            found = byte * total(rest[1:])
            for n in range(1, len(rest) + 1):
                p = model.table.get(rest[:n])
                if p is not None:
                    found += math.exp(p) * total(rest[n:])
            return found

        assert model.log_marginal(word) == pytest.approx(math.log(total(text)))
    assert math.isfinite(model.log_marginal("ab" * 5000))


@pytest.mark.parametrize("share", [5e-6, 0.02, 2.0])
def test_lm_scores(spark, share):
    rows = odd_rows()
    found = lm.score(table(spark, rows), PIECES, common_share=share).collect()
    train = [lm.words(t or "") for d, t, *_ in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    counts = Counter(w for words in train for w in words)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = []
    for d, t, *_ in rows:
        words = lm.words(t or "")
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((str(d), zlib.crc32(str("" if d is None else d).encode()) % 7 == 2, len(words) + 1, sum(w in counts for w in words) + 1, n, round(base, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert lm.score(table(spark, []), PIECES).collect() == []


def test_lm_scores_do_not_depend_on_the_path(spark):
    df = table(spark, odd_rows())
    one, other = ({(r.doc_id, r.n_tokens): r.score for r in lm.score(df, PIECES, common_share=s).collect()} for s in (1e-9, 2.0))
    assert one == pytest.approx(other)


def labelled(spark):
    good = [(i, " ".join(["The river runs past the old mill, and the miller counts his sacks."] * (1 + i % 3))) for i in range(0, 120)]
    bad = [(1000 + i, "BUY!! NOW!! $$$ ### " * (10 + i % 5)) for i in range(60)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(5, None, 0), (None, 1, 0), (7, 1, 0), (7, 1, 1)]
    return good, bad, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    good, bad, labels = labelled(spark)
    df = table(spark, good + bad + odd_rows()[12:])
    model = classifier.fit(df, labels)
    rows = classifier.score(df, model).collect()
    held = {r.doc_id: r.predicted for r in rows if r.held_out}
    assert all(held[i] == (i < 120) for i, _ in good + bad if i in held) and len(held) > 20
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == df.count()
    kept = classifier.keep_good(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)


def test_classifier_without_labels(spark):
    _, _, labels = labelled(spark)
    df = table(spark, odd_rows())
    for model in (classifier.fit(df, labels.limit(0)), classifier.fit(df.limit(0), labels), classifier.fit(df, labels.filter("quality = 1"))):
        assert classifier.score(df, model).count() == len(odd_rows())
        assert classifier.score(df.limit(0), model).collect() == []


def test_attention_gradient():
    draw = np.random.default_rng(1)
    bags, labels = [draw.normal(size=(n, classifier.WIDTH)) for n in (1, 3, 2, 5)], np.array([1.0, 0, 1, 0])
    model = classifier.AttentionModel().fit(bags, labels, epochs=200)
    sizes = np.array([len(b) for b in bags])
    x = np.concatenate(bags)
    scores = model.scores(x, np.cumsum(sizes) - sizes)
    assert np.abs(scores - labels).max() < 0.1

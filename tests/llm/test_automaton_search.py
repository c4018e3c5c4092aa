import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import odd_rows, table
from wearline.llm import scan

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    counted = [(doc, Counter(terms_of(text))) for doc, text, *_ in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    documents, words = len(counted), sum(n for _, _, n in counted)
    holding = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c, n in counted:
            norm = 50 + 50 * n * documents // words
            score = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * norm))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda s: s[:3])
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(scores[:k])]
    return sorted(out, key=str)


def asked(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("term", "rank", "score", "task", "n")})


ITEMS = [
    (0, "the river runs past the old MILL"),
    (1, None),
    (2, ""),
    (3, "one line of text, that stands; twice é"),
    (4, "漢字 \U0001f600 ß aaaa it"),
    (5, "nothing-of-this-kind-occurs_0"),
    (5, "sacks of flour"),
    (None, "miller counts lamp"),
    (6, "the and of by his"),
    (6, "the and of by his"),
]


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rows = odd_rows() + [(None, "the mill"), (70, "the mill"), (60, "the mill"), (60, "the mill"), (71, "\x00the\x7fMILL_river,of")]
    df, items = table(spark, rows), asked(spark, ITEMS)
    for k in (3, 50):
        assert found(scan.search(df, items, k)) == brute(rows, ITEMS, k)
    assert found(scan.search(df, items, 5, pass_bytes=150)) == brute(rows, ITEMS, 5)


def test_small_blocks_and_exact_sums(spark, monkeypatch):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))) for i in range(400)] + [(5, "w1 w2")]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 9)))) for i in range(25)]
    best, scores = scan.Best(3, 2), scan.np.array([[5, 0, 1], [5, 2, 0], [7, 2, 0]])
    best.offer(scores, scan.np.array([9, 4, 8]), scan.np.array([0, 0, 1]))
    best.cut()
    best.offer(scan.np.array([[5, 9, 0]]), scan.np.array([1]), scan.np.array([0]))
    best.cut()
    item, score, null, ids = (c.tolist() for c in best.held)
    assert list(zip(item, score, null, ids)) == [(0, 7, 1, 8), (0, 5, 0, 1), (1, 9, 0, 1), (1, 2, 0, 4), (2, 1, 0, 9)]
    monkeypatch.setattr(scan, "SCORES", 60)
    assert found(scan.search(table(spark, rows), asked(spark, items), 50)) == brute(rows, items, 50)


def test_empty_tables(spark):
    some = odd_rows()
    assert scan.search(table(spark, []), asked(spark, ITEMS)).collect() == []
    assert scan.search(table(spark, some), asked(spark, [])).collect() == []
    assert scan.search(table(spark, some), asked(spark, [(1, None), (2, " -- ")])).collect() == []


def test_guards_keep_parts_of_words_out():
    machine = scan.automaton(["he", "she", "hers", "é"])
    text = scan.guarded("She hers, he-HE é éé the".encode()).decode()
    assert Counter(v for _, v in machine.iter(text)) == {1: 1, 2: 1, 0: 2, 3: 1}

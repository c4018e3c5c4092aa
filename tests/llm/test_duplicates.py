import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import PROSE, odd_rows, table
from wearline.llm import graphs, lines, minhash, rules, suffixes

SPACES = " \t\n\x0b\x0c\r"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def mutated(draw, text, n):
    chars = list(text)
    for _ in range(n):
        at, kind = draw.randrange(len(chars)), draw.randrange(3)
        if kind == 0:
            chars.insert(at, draw.choice("xyzé"))
        elif kind == 1 and len(chars) > 1:
            del chars[at]
        else:
            chars[at] = draw.choice("xyzé")
    return "".join(chars)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    draw = random.Random(threshold)
    pairs = []
    for _ in range(800):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(1, 14)))
        pairs.append((a, mutated(draw, a, draw.randint(0, 4))))
    pairs += [("", ""), ("", "ab"), ("abc", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), threshold).alias("w")).collect()
    assert all(r.w == (edits(r.a, r.b) <= threshold) for r in rows)


def line_rows(draw):
    base = [" ".join(draw.choices(PROSE, k=draw.randint(3, 9))) for _ in range(25)]
    pool = base + [mutated(draw, draw.choice(base), draw.randint(1, 4)) for _ in range(60)] + ["short", "", "  ", base[0] + "  "]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randint(1, 6)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (None, base[3] + "\nnull id"), (52, rows[1][1]), (1, rows[1][1]), (53, "x" * 3000 + "\n" + "x" * 3001)]


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup(spark, threshold):
    rows = line_rows(random.Random(threshold))
    first, low = {}, -(1 << 63)
    for doc, text in rows:
        for part in (text or "").split("\n"):
            part = part.strip(SPACES)
            if len(part) >= 20:
                own = low if doc is None else doc
                first[part] = min(own, first.get(part, own))
    hashes = {r.line: (r.h, r.h2) for r in spark.createDataFrame([(x,) for x in first], "line string").select("line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")).collect()}
    near, degree = set(), Counter()
    for a in first:
        for b in first:
            if a < b and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                degree[a] += 1
                degree[b] += 1
                near.add(max(a, b, key=lambda x: (first[x], *hashes[x])))
    want = []
    for doc, text in rows:
        kept, here = [], set()
        for part in (text or "").split("\n"):
            line = part.strip(SPACES)
            if len(line) >= 20:
                gone = line in near or first[line] < (low if doc is None else doc) or line in here
                here.add(line)
                if gone:
                    continue
            kept.append(part)
        lines_in = 0 if text is None else text.count("\n") + 1
        gone = 0 if text is None else lines_in - len(kept)
        want.append((str(doc), lines_in, gone, sum(degree[x] for x in here), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    df = table(spark, rows)
    found = lines.digest(df, threshold).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.n_links, r.kept_sha256) for r in found) == sorted(want)
    assert near and lines.deduplicated(df).columns[: len(df.columns)] == df.columns
    assert lines.digest(table(spark, [])).collect() == []


def test_line_dedup_keeps_null_text(spark):
    rows = lines.deduplicated(table(spark, odd_rows())).filter("doc_id = 20").collect()
    assert len(rows) == 1 and rows[0].text is None


@pytest.mark.parametrize("threshold", [1, 2])
def test_short_lines_go(spark, threshold):
    draw = random.Random(threshold)
    pool = ["Yes.", "No.", "a", "ab", "abc", "Page 1", "Page 12", "Contents", "Read more", "", "  ", " ".join(PROSE)]
    rows = [(i, "\n".join(draw.choices(pool, k=4))) for i in range(30)]
    first = {}
    for doc, text in rows:
        for part in text.split("\n"):
            first.setdefault(part.strip(SPACES), doc)
    first.pop("")
    hashes = {r.line: (r.h, r.h2) for r in spark.createDataFrame([(x,) for x in first], "line string").select("line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")).collect()}
    linked = [(a, b) for a in first for b in first if a < b and min(len(a), len(b)) > threshold and edits(a, b) <= threshold]
    near = {max(pair, key=lambda x: (first[x], *hashes[x])) for pair in linked}
    degree = Counter(x for pair in linked for x in pair)
    want = []
    for doc, text in rows:
        kept, here = [], set()
        for part in text.split("\n"):
            line = part.strip(SPACES)
            if not line or not (line in near or first[line] < doc or line in here):
                kept.append(part)
            here.add(line)
        want.append((doc, sum(degree[x] for x in here), "\n".join(kept)))
    found = lines.deduplicated(table(spark, rows), threshold, least_chars=1).select("doc_id", "n_links", "text").collect()
    assert sorted(map(tuple, found)) == want and linked
    query = spark.createDataFrame([(1, "Yes.\none"), (2, "Yes.\ntwo hundred")], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.line_dedup(spark, query, "").orderBy("doc_id").select("text").collect()] == [("Yes.\none",), ("two hundred",)]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_links_across_buckets(spark, threshold, monkeypatch):
    """Pairs up to the threshold apart, with lengths on both sides of every kind of bucket border, each found."""
    monkeypatch.setattr(lines, "_OFTEN", 1)
    draw = random.Random(threshold)
    pool = []
    for n in (4, 5, 8, 14, 15, 16, 17, 31, 32, 33, 63, 64, 66, 129, 255, 257):
        for _ in range(6):
            base = "".join(draw.choice("abé .") for _ in range(n)).strip(SPACES).rjust(n, "a")
            pool += [base] + [mutated(draw, base, draw.randint(1, threshold + 1)).strip(SPACES) for _ in range(3)]
    pool = sorted({x for x in pool if x})
    want = Counter(x for a in pool for b in pool if a < b and min(len(a), len(b)) > threshold and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold for x in (a, b))
    rows = list(enumerate(pool)) + [(1000 + i, x) for i, x in enumerate(pool[::7])]
    found = lines.digest(table(spark, rows), threshold, least_chars=1).collect()
    assert {r.doc_id: r.n_links for r in found} == {i: want[x] for i, x in rows}
    lengths = {len(x) for x in want}
    assert any(a < 16 <= b or a < 32 <= b or a < 64 <= b for a in lengths for b in lengths if 0 < b - a <= threshold)


def test_long_lines_have_few_keys(spark):
    rows = spark.range(200, 400).selectExpr("repeat('x', int(id)) AS line", "int(id) AS n", "id AS h")
    assert lines._keys(rows, 2).count() <= 5 * 200


def test_lines_of_a_document_are_split_once(spark):
    """The texts are read for the lines and for the result, whatever is done with the lines in between."""
    reads = spark.sparkContext.accumulator(0)

    def counted(text):
        reads.add(1)
        return text

    same = F.udf(counted, "string").asNondeterministic()
    rows = [(i, f"Read more\n{' '.join(PROSE)} {i}\nthe only one {i * 7919}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", same("text"))
    assert sum(r.n_removed for r in lines.deduplicated(df, least_chars=1).collect()) > 50
    assert reads.value <= 2 * len(rows)


def brute_rules(rows, share, least):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t, _ in rows]
    normal, hosts, seen = [], Counter(), Counter()
    for _, text, host in rows:
        own = [" ".join(w for w in re.split(r"[\x20\x09-\x0D]+", p.lower()) if w) for p in (text or "").split("\n")]
        normal.append([x for x in own if x])
        hosts[host or ""] += 1
        seen.update({(host or "", x) for x in normal[-1]})
    out = []
    for (doc, text, host), w, own in zip(rows, words, normal):
        text, host = text or "", host or ""
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
        parts = [p for p in text.split("\n") if p.strip(SPACES)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        removed = sum(len(x.split(" ")) for x in own if seen[host, x] > least and seen[host, x] > share * hosts[host])
        left = len(w) - removed
        kept = not failed and left >= 10 and left >= 0.5 * len(w)
        out.append((str(doc), len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(parts) - len(set(parts)), len(covered), failed, kept, removed))
    return sorted(out)


def test_line_frequency(spark):
    draw = random.Random(5)
    common = "Read more on our  site every day of the week"
    rows = [(i, "\n".join([common if i % 2 else common.upper(), " ".join(draw.choices(PROSE, k=draw.choice([3, 15, 40])))]), draw.choice(["a", "b", None])) for i in range(90)]
    rows += [(r[0], r[1], "a") for r in odd_rows()] + [(200, "a b c d e f g h i j k a b c d e f", None), (201, "x " * 400, "")]
    found = rules.line_frequency(table(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words) for r in found)
    assert got == brute_rules(rows, 0.1, 20)
    assert any(not r.kept and not r.base_failed for r in found)
    assert rules.line_frequency(table(spark, [])).collect() == []


def test_components(spark):
    draw = random.Random(6)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else top(parent[x])

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    found = {r.id: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: top(x) for x in parent if any(a != b and x in (a, b) for a, b in links)}


def near_rows(draw, group=40):
    base = [draw.choices(PROSE, k=draw.randint(60, 120)) for _ in range(8)]
    words = [f"w{i}" for i in range(5000)]
    base += [draw.choices(words, k=80) for _ in range(10)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(group):  # near copies of one text, alike to different degrees
        own = list(base[9])
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((100 + i, " ".join(own)))
    shared = draw.choices(words, k=60)  # a passage that many texts share
    rows += [(200 + i, " ".join(shared + draw.choices(words, k=draw.randint(5, 60)))) for i in range(group)]
    return rows + odd_rows()


@pytest.mark.parametrize("block", [256, 5])
def test_minhash_classes(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "_BLOCK", block)
    rows = near_rows(random.Random(7))
    df = table(spark, rows)
    found = minhash.classes(df).collect()
    sampler = minhash.sampler_of(df)
    sets = [(d, minhash.words(t or ""), sampler.shingles(t or "")) for d, t, *_ in rows]
    parent = list(range(len(sets)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i, (a, one, x) in enumerate(sets):
        for j, (b, other, y) in enumerate(sets[:i]):
            if a is not None and b is not None and (one == other or sampler.similarity(x, y) >= 0.8):
                parent[top(i)] = top(j)
    smallest = {}
    for i, (d, _, _) in enumerate(sets):
        if d is not None:
            smallest[top(i)] = min(d, smallest.get(top(i), d))
    want = sorted((str(d), smallest.get(top(i))) for i, (d, _, _) in enumerate(sets))
    assert sorted((str(r.doc_id), r.class_id) for r in found) == want
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {i for i in ids if i is not None} == set(smallest.values()) and ids.count(None) == 1
    assert minhash.classes(table(spark, [])).collect() == []


def test_minhash_weighs_rare_words(spark):
    """Over 1,000 rows, pairs that differ in a word of 1 and of 3 documents, at both sides of the limit."""
    draw = random.Random(10)
    fill = [f"f{i}" for i in range(40)]
    rows = [(10_000 + i, " ".join(draw.choices(fill, k=12))) for i in range(3300)]
    for i in range(120):
        own = [f"{'common' if i % 2 else 'p'}{i}x{k}" if draw.random() < 0.6 else draw.choice(fill) for k in range(draw.randint(24, 80))]
        changed = list(own)
        changed[-draw.randint(2, 9)] = f"q{i}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(changed))]
        if i % 3 == 0:
            rows += [(50_000 + 3 * i + k, f"q{i} " + " ".join(draw.choices(fill, k=12))) for k in range(2)]
    seen = Counter(w for _, t in rows for w in set(minhash.words(t)))
    exact = minhash.Sampler({w: 1 + math.log(len(rows) / n) for w, n in seen.items()}, 0.0, 4)
    limited = minhash.Sampler({w: 1 + math.log(len(rows) / max(n, 0.001 * len(rows))) for w, n in seen.items()}, 0.0, 4)
    text = dict(rows)

    def alike(sampler, i):
        return sampler.similarity(sampler.shingles(text[2 * i]), sampler.shingles(text[2 * i + 1]))

    df = table(spark, rows)
    found = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert len(found) == len(rows)
    close = [i for i in range(120) if alike(exact, i) < 0.8 or alike(exact, i) > 0.83]
    assert all((found[2 * i + 1] == found[2 * i]) <= (alike(exact, i) >= 0.8) for i in range(120))
    assert sum((found[2 * i + 1] == found[2 * i]) == (alike(exact, i) >= 0.8) for i in close) >= len(close) - 2
    # the weights the texts bring are the true ones
    texts = minhash._with_key(df.select("doc_id", "text"))
    counted = minhash.frequencies(texts)
    sampler, total, least = minhash._frequent(counted, 4, minhash.LEAST_SHARE)
    given = minhash._rare_words(texts, counted, spark.sparkContext.broadcast(sampler), least)
    with_text = [(r.text or "", r.rare) for r in texts.join(given, "key", "left").collect()]
    brought = {w: x for own in minhash._own(*map(list, zip(*with_text)), sampler, total) for w, x in own.items()}
    assert total == len(rows) and sampler.rare == pytest.approx(exact.idf[b"q1"])
    assert brought and brought == pytest.approx({w: exact.idf[w] for w, n in seen.items() if 1 < n < least})
    assert sampler.idf == pytest.approx({w: exact.idf[w] for w, n in seen.items() if n >= least})
    assert any(alike(exact, i) != pytest.approx(alike(limited, i), abs=1e-3) for i in range(120))


def test_samples_agree_with_similarity():
    draw = random.Random(8)
    idf = {w.encode(): 1 + draw.random() * 5 for w in PROSE}
    sampler = minhash.Sampler(idf, 7.0, samples=4000)
    a = draw.choices(PROSE, k=60)
    b = a[:45] + draw.choices(PROSE, k=15)
    one, other = sampler.shingles(" ".join(a)), sampler.shingles(" ".join(b))
    signature = sampler.signatures([one, other])
    assert (signature[0] == signature[1]).mean() == pytest.approx(sampler.similarity(one, other), abs=0.03)


def test_block_links_equal_single_pairs():
    draw = random.Random(9)
    texts = [t for _, t, *_ in near_rows(draw, 25) if t and len(t) < 5000]
    sampler = minhash.Sampler({}, 2.0, 4)
    found = minhash.block_links(sampler, texts, list(range(len(texts))), None, 0.8)
    parent, want = list(range(len(texts))), list(range(len(texts)))

    def top(p, x):
        return x if p[x] == x else top(p, p[x])

    for i, j in found:
        parent[top(parent, j)] = top(parent, i)
    for i in range(len(texts)):
        for j in range(i):
            if sampler.similarity(sampler.shingles(texts[i]), sampler.shingles(texts[j])) >= 0.8:
                want[top(want, i)] = top(want, j)
    same = lambda p: [[top(p, i) == top(p, j) for i in range(len(p))] for j in range(len(p))]
    assert same(parent) == same(want)


def test_shingles_and_samples_of_many_texts_equal_single_ones(monkeypatch):
    draw = random.Random(15)
    texts = ["", "a b", *(" ".join(draw.choices(PROSE[:40], k=draw.randint(0, 60))) for _ in range(60)), "x x x x x x x"]
    seen = Counter(w for t in texts for w in set(minhash.words(t)))
    sampler = minhash.Sampler({w: 1.0 + n for w, n in list(seen.items())[:20]}, 9.0, 12)
    rare = [[(i << minhash._NUMBER) + seen[w] for i, w in enumerate(minhash._apart(minhash.words(t), sampler.idf)) if seen[w] > 1] for t in texts]
    single = [sampler.counted(t, own) for t, own in zip(texts, minhash._own(texts, rare, sampler, len(texts)))]
    together = sampler.counted_all(list(map(minhash.words, texts)), rare=rare, total=len(texts))
    assert [[x.tolist() for x in s] for s in together] == [[x.tolist() for x in s] for s in single]
    sets = [(h, u * n) for h, u, n in together if len(h)]
    alone = [sampler.signatures([s])[0].tolist() for s in sets]
    monkeypatch.setattr(minhash, "_DRAWN", 70)
    assert sampler.signatures(sets).tolist() == alone


def test_anchors_of_many_texts_equal_single_ones(monkeypatch):
    draw = random.Random(16)
    texts = [b"", b"x" * 49, b"y" * 50, b"z" * 300, *(bytes(draw.choices(b"abc ", k=draw.randint(0, 200))) for _ in range(80)), b"", b"tail"]
    single = [[x.tolist() for x in suffixes.anchors([t])[0]] for t in texts]
    for size in (1, 500, 1 << 16):
        monkeypatch.setattr(suffixes, "_HASHED_BYTES", size)
        assert [[x.tolist() for x in own] for own in suffixes.anchors(texts)] == single
    assert [len(t) - 49 for t in texts if len(t) >= 50] == [s[2][-1] + 1 for s in single if s[2]]


def test_shared_part_of_snippets_is_sorted_once(monkeypatch):
    sizes, sort = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: sizes.append(len(text)) or sort(text))
    part = bytes(random.Random(17).choices(range(97, 123), k=60))
    ends = [(b"1", b"2"), (b"3", b"4"), (b"5", b"6")]
    texts = [a * 9 + part + b * 9 for a, b in ends]
    found = suffixes.smallest_owner({t: (doc, 29) for doc, t in zip((7, 4, 9), texts)}, 50)
    assert sizes == [61]
    assert found == {t: [(9, doc), (20, 4), (29, doc)] if doc != 4 else [(29, 4)] for doc, t in zip((7, 4, 9), texts)}


def test_suffix_array():
    draw = random.Random(10)
    for _ in range(1500):
        text = [draw.randint(0, draw.choice([0, 1, 2, 25])) for _ in range(draw.randint(0, 40))]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffixes.suffix_array(b"ab" * 3000)[0] == 5998


def brute_suffixes(rows, length):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], doc)
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if doc is not None and first[text[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(b for b, x in zip(text, gone) if not x)
        out.append((str(doc), len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, split_above", [(50, 2048), (12, 2048), (12, 3)])
def test_suffix_dedup(spark, length, split_above):
    draw = random.Random(length)
    passages = [" ".join(draw.choices(PROSE, k=14)) for _ in range(6)]
    rows = odd_rows()
    for i in range(40):
        parts = draw.choices([*passages, "a" * 90, "ab" * 40, "é" * 30, "".join(draw.choices("xyz", k=25))], k=draw.randint(1, 4))
        rows.append((300 + i, draw.choice(["", " ", "q"]).join(p[draw.randint(0, 9) :] for p in parts)))
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    found = suffixes.deduplicated(table(spark, rows), length, split_above)
    found = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_suffixes(texts, length)
    assert suffixes.digest(table(spark, [])).collect() == []


def test_shortened_keeps_columns(spark):
    df = table(spark, odd_rows())
    out = suffixes.shortened(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.filter("doc_id = 20").first().text is None
    assert out.filter("doc_id = 24").first().text == ""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import odd_rows, table
from wearline.llm import bestfit

WORDS = public_tokenizers.path("word_bpe_49k.json")


def optimum(items, window, most):
    """The least number of sequences, by trying all assignments."""
    items = tuple(sorted(items, reverse=True))

    def fits(i, rooms, seen):
        if i == len(items):
            return True
        key = (i, tuple(sorted(rooms)))
        if key in seen:
            return False
        seen.add(key)
        for room in sorted({r for r in rooms if r >= items[i]}):
            rest = list(rooms)
            rest.remove(room)
            if fits(i + 1, [*rest, room - items[i]], seen):
                return True
        return False

    return next(k for k in range(most + 1) if fits(0, [window] * k, set()))


def counted(items, window):
    return np.bincount(np.array(items, np.int64), minlength=window + 1)


def contents(plan, counts):
    keys, rows = plan.table()
    filled = defaultdict(list)
    for length in np.flatnonzero(counts).tolist():
        for rank in range(counts[length]):
            _, first, each, sequence, offset = rows[np.searchsorted(keys, length << 42 | rank, side="right") - 1].tolist()
            filled[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    return filled


def small_instances(n=600, seed=2):
    draw = random.Random(seed)
    for _ in range(n):
        window = draw.choice([10, 20, 37])
        least = draw.choice([1, 3, window // 4])
        yield [draw.randint(least, window) for _ in range(draw.randint(0, 10))], window


def test_reduction_keeps_an_optimum():
    for items, window in small_instances():
        plan = bestfit.Plan(counted(items, window), window)
        bestfit.reduce(plan)
        rest = [i for i in range(window + 1) for _ in range(plan.left[i])]
        assert plan.fixed + optimum(rest, window, len(rest)) == optimum(items, window, len(items)), items


def test_fixed_sets_dominate():
    """Against every other feasible set with the piece, by dealing it into groups."""
    draw = random.Random(8)

    def dealt(own, other):
        if not other:
            return True
        return any(r >= other[0] and dealt([*own[:i], r - other[0], *own[i + 1 :]], other[1:]) for i, r in enumerate(own))

    def sets(sizes, room):
        yield ()
        for i, s in enumerate(sizes):
            if s <= room:
                for more in sets(sizes[i + 1 :], room - s):
                    yield (s, *more)

    for _ in range(300):
        window = 24
        items = [draw.randint(3, window) for _ in range(draw.randint(1, 7))]
        for j in set(items):
            found = bestfit.dominating(counted(items, window), j, window)
            if found is None:
                continue
            others = list(items)
            others.remove(j)
            own = list(found)
            own.remove(j)
            for s in sets(sorted(others, reverse=True), window - j):
                assert dealt(own, s), (items, j, found, s)


def test_plan_holds_each_piece_once():
    draw = random.Random(4)
    for _ in range(60):
        window = 64
        items = [min(window, int(draw.expovariate(0.08)) + 1) for _ in range(draw.randint(0, 2000))]
        counts = counted(items, window)
        plan = bestfit.planned(counts, window)
        filled = contents(plan, counts)
        assert sorted(filled) == list(range(plan.sequences))
        for pieces in filled.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= window
        least = bestfit.least_sequences(counts, window)
        assert least <= plan.sequences <= least + 1 + len(items) // 200


def test_bound_is_a_bound():
    for items, window in small_instances(200, 6):
        assert bestfit.least_sequences(counted(items, window), window) <= optimum(items, window, len(items))


def test_like_pieces_are_planned_together():
    """A million times the pieces: nearly the same plan, as driver work does not grow with the corpus."""
    rng = np.random.default_rng(0)
    lengths = np.clip(np.exp(rng.normal(6, 1.4, 20_000)).astype(int) + 1, 1, 4096)
    counts = counted(lengths, 4096)
    small, large = bestfit.planned(counts, 4096), bestfit.planned(counts * 10**6, 4096)
    assert len(large.rows) < 2 * len(small.rows)
    assert large.sequences <= bestfit.least_sequences(counts * 10**6, 4096) * 1.001


@pytest.mark.parametrize("window", [4096, 64])
def test_pack(spark, window):
    rows = odd_rows() + [(500 + i, "one and the same text") for i in range(300)]
    got = bestfit.pack(table(spark, rows), WORDS, window, 1).collect()
    library = Tokenizer.from_file(WORDS)
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, i, at, len(ids[at : at + window]), zlib.crc32(ids[at : at + window].tobytes())) for i, at in enumerate(range(0, len(ids), window))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    lengths = counted([w[3] for w in want], window)
    assert len(filled) <= 1 + 1.01 * bestfit.least_sequences(lengths, window)
    assert bestfit.pack(table(spark, []), WORDS, window, 1).collect() == []

"""Decision trees over binned rows, each grown within one task by the steps of Spark's tree learners.

``bins`` has a row per feature and a column per row: bin ``b`` holds the values above
threshold ``b - 1``, up to and with threshold ``b``. A split at bin ``b`` sends bins up to it to the
left. All nodes of a level are split together, from one histogram of the rows that are still in open
nodes; every row remembers its node.

A tree is a dict of arrays over its nodes: ``feature`` (``LEAF`` at a leaf), ``bin`` and ``child``,
the left child (the right one follows it) or, at a leaf, its row in ``values``.
"""

from __future__ import annotations

import io

import numpy as np

LEAF = 0xFFFF
#: Cells of one histogram; nodes of a level beyond that are split in turns.
CELLS = 1 << 22
#: Impurity below which Spark's learners do not split a child.
PURE = 2.0**-52


def thresholds(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Borders between at most ``bins`` bins of about equal weight; ``values`` are distinct and ascending."""
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) < bins:
        return between
    so_far = np.cumsum(weight)
    middle = (so_far[:-1] + so_far[1:]) / 2.0  # a border lies where the weight so far is nearest to its share
    stride, found, last = so_far[-1] / bins, [], -1
    while (last := max(last + 1, int(np.searchsorted(middle, (len(found) + 1) * stride, side="right")))) < len(middle):
        found.append(last)
    return between[found]


def binned(columns: list[np.ndarray], borders: list[list[float]]) -> np.ndarray:
    """Bins of columns of numbers; NaN lies beyond the last border."""
    return np.stack([np.searchsorted(b, c, side="left").astype(np.uint8) for c, b in zip(columns, borders)])


def _cells(bins, rows, node, feature, size, extra=None):
    """Place of each row in a flat histogram by node, choice of feature, bin (and ``extra``, with its size)."""
    chosen = feature[node]
    cell = bins.ravel()[chosen * bins.shape[1] + rows[:, None]].astype(np.int64)
    cell += (node[:, None] * feature.shape[1] + np.arange(feature.shape[1])) * size
    if extra is not None:
        cell = cell * extra[1] + extra[0][:, None]
    return cell.ravel()


def _gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 1.0 - np.square(counts / total[..., None]).sum(-1)


def _subsets(draw: np.random.Generator, nodes: int, features: int, subset: int) -> np.ndarray:
    """Features each node chooses among, by reservoir sampling; of equal gains the first wins."""
    out = np.tile(np.arange(subset), (nodes, 1))
    for f in range(subset, features):
        slot = (draw.random(nodes) * (f + 1)).astype(np.int64)
        at = np.flatnonzero(slot < subset)
        out[at, slot[at]] = f
    return out


def _best(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Choice of feature, bin and gain of each node's first best split."""
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(at)), at]


def _turns(node: np.ndarray, nodes: int, cells: int):
    """Nodes, and the rows in them (sorted by node), that share a histogram."""
    step = max(1, CELLS // cells)
    for first in range(0, nodes, step):
        past = min(first + step, nodes)
        yield first, past, slice(*np.searchsorted(node, [first, past]))


def classifier(bins, label, count, weight, size, depth, subset, seed) -> tuple[dict, np.ndarray]:
    """A tree of a random forest, and its features' importance.

    Equal rows come once, with their ``count``, and are drawn with replacement (as often as a Poisson
    number with that mean says). Each node chooses among ``subset`` features; splits lower the Gini
    impurity of counts times the classes' ``weight``. Leaves of one parent that predict the same
    class become one. ``values`` are a leaf's class shares.
    """
    draw = np.random.default_rng(seed)
    times = draw.poisson(count)
    rows = np.flatnonzero(times)
    times = times.astype(np.float64)
    n_features, n_classes = len(bins), len(weight)
    node = np.zeros(len(rows), np.int64)
    stats = np.bincount(label[rows], times[rows], n_classes)[None].astype(np.float64)  # integers if nothing was drawn
    levels = []
    for level in range(depth + 1):
        found = {"stats": stats, "feature": np.full(len(stats), LEAF), "bin": np.zeros(len(stats), np.int64), "child": np.zeros(len(stats), np.int64), "gain": np.zeros(len(stats))}
        levels.append(found)
        is_open = (np.count_nonzero(stats, axis=1) > 1) & (level < depth)
        if not is_open.any():
            break
        stay = is_open[node]
        rows, node, of_open = rows[stay], (np.cumsum(is_open) - 1)[node[stay]], np.flatnonzero(is_open)
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        feature = _subsets(draw, len(of_open), n_features, subset)
        choice, border, gain = (np.zeros(len(of_open), t) for t in (np.int64, np.int64, np.float64))
        for first, past, part in _turns(node, len(of_open), subset * size * n_classes):
            cells = _cells(bins, rows[part], node[part] - first, feature[first:past], size, (label[rows[part]], n_classes))
            shape = (past - first, subset, size, n_classes)
            left = np.bincount(cells, np.repeat(times[rows[part]], subset), int(np.prod(shape))).reshape(shape).cumsum(2)
            whole = stats[of_open[first:past]]
            right = whole[:, None, None] - left
            valid = (left.sum(-1) >= 1) & (right.sum(-1) >= 1)
            left, right, whole = left * weight, right * weight, whole * weight
            n_left, n_right, n = left.sum(-1), right.sum(-1), whole.sum(-1)
            with np.errstate(invalid="ignore", divide="ignore"):
                lower = n_left / n[:, None, None] * _gini(left, n_left) + n_right / n[:, None, None] * _gini(right, n_right)
            got = np.where(valid, _gini(whole, n)[:, None, None] - lower, -np.inf)
            choice[first:past], border[first:past], gain[first:past] = _best(got)
        splits = gain > 0
        chosen = feature[np.arange(len(of_open)), choice]
        at = of_open[splits]
        found["feature"][at], found["bin"][at], found["gain"][at] = chosen[splits], border[splits], gain[splits]
        found["child"][at] = 2 * np.arange(len(at))
        stay = splits[node]
        rows, node = rows[stay], node[stay]
        node = 2 * (np.cumsum(splits) - 1)[node] + (bins[chosen[node], rows] > border[node])
        stats = np.bincount(node * n_classes + label[rows], times[rows], 2 * len(at) * n_classes).reshape(-1, n_classes)
    weighted = [x["stats"] * weight for x in levels]
    _pruned(levels, [x.argmax(1) for x in weighted])
    importance = np.zeros(n_features)
    for found, w in zip(levels, weighted):
        inner = found["feature"] != LEAF
        np.add.at(importance, found["feature"][inner], (found["gain"] * w.sum(1))[inner])
    tree, stats = _joined(levels)
    kinds, tree["child"] = _leaves(tree, stats)
    total = (kinds * weight).sum(1, keepdims=True)
    tree["values"] = np.divide(kinds * weight, total, out=np.zeros_like(kinds), where=total > 0)
    return tree, importance / importance.sum() if importance.sum() > 0 else importance


def _pruned(levels: list[dict], prediction: list[np.ndarray]) -> None:
    """Nodes whose children are leaves with one prediction become leaves, from the last level up."""
    for found, below, says in zip(levels[-2::-1], levels[:0:-1], prediction[:0:-1]):
        at = np.flatnonzero(found["feature"] != LEAF)
        left = found["child"][at]
        leaves = (below["feature"][left] == LEAF) & (below["feature"][left + 1] == LEAF)
        found["feature"][at[leaves & (says[left] == says[left + 1])]] = LEAF


def _joined(levels: list[dict]) -> tuple[dict, np.ndarray]:
    """One numbering of the nodes that can be reached, level by level, and their statistics."""
    kept, first = np.zeros(1, np.int64), 0
    parts = {k: [] for k in ("feature", "bin", "child", "stats", "gain")}
    for found in levels:
        feature = found["feature"][kept]
        inner = feature != LEAF
        first += len(kept)
        for k in ("feature", "bin", "stats", "gain"):
            parts[k].append(found[k][kept])
        parts["child"].append(np.where(inner, first + 2 * (np.cumsum(inner) - 1), 0))
        left = found["child"][kept[inner]]
        kept = np.stack([left, left + 1], axis=1).ravel()
        if not len(kept):
            break
    whole = {k: np.concatenate(v) for k, v in parts.items()}
    stats = whole.pop("stats")
    return {"feature": whole["feature"].astype(np.uint16), "bin": whole["bin"].astype(np.uint8), "child": whole["child"], "gain": whole["gain"]}, stats


def _leaves(tree: dict, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves' distinct statistics, and ``child`` with each leaf's row among them."""
    leaf = tree["feature"] == LEAF
    kinds, place = np.unique(stats[leaf], axis=0, return_inverse=True)
    child = tree["child"].astype(np.int32)
    child[leaf] = place.ravel()
    del tree["gain"]
    return kinds, child


def regressor(bins, target, part, size, depth) -> tuple[dict, np.ndarray]:
    """A tree that lowers the variance of ``target``, and the prediction for each row.

    Besides the arrays of a tree it has ``stats`` (count, sum and sum of squares) and ``gain`` of
    every node; a leaf has no ``values``, it predicts its mean. Features that split a node's rows
    alike differ by rounding only, so sums run as Spark's do, over each ``part`` (its rows come
    in order) and then over the parts, and such ties fall as they do there.
    """
    rows, node, parts = np.arange(len(target)), np.zeros(len(target), np.int64), int(part.max()) + 1
    sums = (np.ones(len(target)), target, target * target)
    predicted, stats, levels = np.empty(len(target)), None, []
    for level in range(depth + 1):
        nodes = 1 if stats is None else len(stats)
        is_open = np.full(nodes, level < depth) if stats is None else (np.abs(_variance(stats)) >= PURE) & (level < depth)
        gain, border, chosen = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        below = np.zeros((2, nodes, 3))
        for f in range(len(bins) if is_open.any() or stats is None else 0):
            cells = (part[rows] * nodes + node) * size + bins[f, rows]
            each = [np.bincount(cells, x[rows], parts * nodes * size).reshape(parts, -1).sum(0) for x in sums]
            left = np.stack(each, axis=-1).reshape(nodes, size, 3).cumsum(1)
            right = left[:, -1:] - left
            if stats is None:
                stats = left[:, 0] + right[:, 0]
            n = stats[:, None, 0]
            with np.errstate(invalid="ignore", divide="ignore"):
                got = _variance(stats)[:, None] - left[..., 0] / n * _variance(left) - right[..., 0] / n * _variance(right)
            got = np.where((left[..., 0] >= 1) & (right[..., 0] >= 1), got, -np.inf)
            _, at, best = _best(got[:, None])
            better = best > gain
            gain[better], border[better], chosen[better] = best[better], at[better], f
            below[0, better], below[1, better] = left[better, at[better]], right[better, at[better]]
        predicted[rows] = (stats[:, 1] / stats[:, 0])[node]
        splits = is_open & (gain > 0)
        at = np.flatnonzero(splits)
        found = {"stats": stats, "feature": np.full(nodes, LEAF), "bin": border, "child": np.zeros(nodes, np.int64), "gain": gain}
        found["feature"][at], found["child"][at] = chosen[at], 2 * np.arange(len(at))
        levels.append(found)
        if not len(at):
            break
        stay = splits[node]
        rows, node = rows[stay], node[stay]
        node = 2 * (np.cumsum(splits) - 1)[node] + (bins[chosen[node], rows] > border[node])
        stats = below[:, at].swapaxes(0, 1).reshape(-1, 3)
    _pruned(levels, [x["stats"][:, 1] / x["stats"][:, 0] for x in levels])
    tree, tree["stats"] = _joined(levels)
    return tree, predicted


def _variance(stats: np.ndarray) -> np.ndarray:
    n = stats[..., 0]
    return (stats[..., 2] - stats[..., 1] * stats[..., 1] / n) / n


def boosted(bins, target, part, size, depth, rounds, rate) -> list[dict]:
    """Trees of gradient boosting on squared errors: the first on ``target``, the others on twice what is left, times ``rate``."""
    trees, so_far = [], np.zeros(len(target))
    for i in range(rounds):
        tree, predicted = regressor(bins, 2.0 * (target - so_far) if i else target, part, size, depth)
        so_far = so_far + (rate if i else 1.0) * predicted
        trees.append(tree)
    return trees


def shares(trees: list[dict], bins: np.ndarray) -> np.ndarray:
    """Each row's class shares, summed over the trees."""
    flat, n = bins.ravel().astype(np.int64), bins.shape[1]
    out = np.zeros((n, trees[0]["values"].shape[1]))
    for tree in trees:
        feature, border, child = (tree[k].astype(np.int64) for k in ("feature", "bin", "child"))
        rows, node = np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            f = feature[node]
            leaf = f == LEAF
            if leaf.any():
                out[rows[leaf]] += tree["values"][child[node[leaf]]]
                rows, node, f = rows[~leaf], node[~leaf], f[~leaf]
            node = child[node] + (flat[f * n + rows] > border[node])
    return out


def packed(tree: dict) -> bytes:
    sink = io.BytesIO()
    np.savez_compressed(sink, **tree)
    return sink.getvalue()


def unpacked(body: bytes) -> dict:
    with np.load(io.BytesIO(body), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}

"""Exact top-k search by term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
CHUNK = 64


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) for each component x, as double arithmetic."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """False for null vectors and those with a null or non-finite component."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.coalesce(~bad, F.lit(False))


def _coordinates(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of each non-zero component."""
    sizes = np.array([len(v) for v in vectors], dtype=np.int64)
    if not sizes.sum():
        return (np.zeros(0, np.int64),) * 3
    values = np.concatenate([np.asarray(v, dtype=np.int64) for v in vectors])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = values != 0
    return rows[keep], dims[keep], values[keep]


def _by_dimension(rows, dims, values) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The posting list of each dimension: rows and values, rows ascending."""
    order = np.argsort(dims, kind="stable")
    rows, dims, values = rows[order], dims[order], values[order]
    names, starts = np.unique(dims, return_index=True)
    ends = np.append(starts[1:], len(dims))
    return {int(d): (rows[a:b], values[a:b]) for d, a, b in zip(names, starts, ends)}


def _score_type(queries: np.ndarray, values: np.ndarray, dims: int):
    """The narrowest integers that hold every score."""
    most = int(np.abs(queries.astype(object)).max(initial=0)) * int(np.abs(values.astype(object)).max(initial=0)) * dims
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query of one block."""
    queries = queries.loc[~pd.DataFrame({"i": queries["id"], "v": queries["v"].map(tuple)}).duplicated().to_numpy()]
    candidates = candidates.loc[~pd.DataFrame({"i": candidates["id"], "v": candidates["v"].map(tuple)}).duplicated().to_numpy()]
    candidates = candidates.sort_values("id", kind="stable")
    ids = candidates["id"].to_numpy(np.int64)
    rows, dims, values = _coordinates(candidates["v"].tolist())
    q_rows, q_dims, q_values = _coordinates(queries["v"].tolist())
    kind = _score_type(q_values, values, int(max(dims.max(initial=0), q_dims.max(initial=0))) + 1)
    postings = {d: (r, v.astype(kind)) for d, (r, v) in _by_dimension(rows, dims, values).items()}
    q_ids, n = queries["id"].to_numpy(np.int64), len(ids)
    found = []
    for at in range(0, len(q_ids), CHUNK):
        own = q_ids[at : at + CHUNK]
        scores = np.zeros((len(own), n), dtype=kind)
        part = (q_rows >= at) & (q_rows < at + CHUNK)
        terms = _by_dimension(q_rows[part] - at, q_dims[part], q_values[part].astype(kind))
        for d, (weighted, weights) in terms.items():
            if d not in postings:
                continue
            hit, value = postings[d]
            whole = len(hit) == n
            for row, weight in zip(weighted, weights):
                if whole:
                    scores[row] += weight * value
                else:
                    scores[row, hit] += weight * value
        for row, own_id in enumerate(own):
            line = scores[row]
            allowed = np.flatnonzero(ids != own_id)
            line = line[allowed]
            if len(line) > k:
                least = np.partition(line, len(line) - k)[len(line) - k]
                chosen = np.flatnonzero(line >= least)
            else:
                chosen = np.arange(len(line))
            chosen = chosen[np.argsort(-line[chosen].astype(object if kind is object else np.int64), kind="stable")][:k]
            found += [(int(own_id), int(ids[allowed[i]]), int(line[i])) for i in chosen]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` candidates with the largest integer inner product for each query.

    Both frames have ``vec_id`` and ``embedding``; other columns are ignored.
    Every pair of a query block and a candidate block is one task: sparse query
    rows scatter their weighted postings into dense score rows, the block's k
    best are selected by partition, and the blocks' winners are merged.

    Rows with a null id, a null vector, or a null or non-finite component take
    no part. Vectors of different length meet in the components both have (the
    rest counts as 0); an empty vector scores 0. A row never finds its own id.
    A repeated row counts once; an id with several vectors has its best score.
    Ties go to the smaller id. Empty inputs give no rows.

    Returns ``query_id, rank, vec_id, score``.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return rows.select(F.col("vec_id").cast("long").alias("id"), whole_components(F.col("embedding"), scale).alias("v"))

    left, right = prepared(queries), prepared(candidates)
    n_left = max(1, math.ceil(queries.count() / QUERY_ROWS))
    n_right = max(1, math.ceil(candidates.count() / BLOCK_ROWS))
    left = left.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    right = right.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    )

    def scored(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_of_block(q, c, k)

    winners = (
        left.groupBy("q", "c")
        .cogroup(right.groupBy("q", "c"))
        .applyInPandas(scored, "query_id long, vec_id long, score long")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        winners.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

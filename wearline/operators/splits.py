"""Train / validation / test membership and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.columns import require
from wearline.operators.lookups import join_null_safe, sized
from wearline.operators.ordering import with_position


def machine_split(
    df: DataFrame, train: float = 0.7, validation: float = 0.15, *, key: str = "machine_id"
) -> DataFrame:
    """Table of key and ``split``: sorted ids cut into train, validation and test."""
    if train + validation >= 1.0:
        raise ValueError("train and validation fractions must sum to less than 1")
    ids = with_position(df.select(key).distinct(), [key])
    n = ids.count()
    n_train, n_val = max(1, int(n * train)), max(1, int(n * validation))
    return _cut_ids(ids, key, n, n_train, n_val, n - n_train - n_val)


def tail_split(
    df: DataFrame, validation: float = 0.15, test: float = 0.15, *, key: str = "machine_id"
) -> DataFrame:
    """Variant that sizes test and validation and leaves the remaining ids to train."""
    ids = with_position(df.select(key).distinct(), [key])
    n = ids.count()
    n_test, n_val = max(1, int(n * test)), max(1, int(n * validation))
    return _cut_ids(ids, key, n, n - n_test - n_val, n_val, n_test)


def _cut_ids(ids: DataFrame, key: str, n: int, n_train: int, n_val: int, n_test: int) -> DataFrame:
    if n == 0:
        raise ValueError("no machines to split")
    if n_test < 1 or n_train < 1:
        raise ValueError(f"{n} machines cannot fill three splits")
    at = F.col("position")
    split = F.when(at < n_train, "train").when(at < n_train + n_val, "validation").otherwise("test")
    return ids.select(key, split.alias("split"))


def with_split(df: DataFrame, split: DataFrame, key: str = "machine_id") -> DataFrame:
    """Joins membership, broadcasting the id table when it is small."""
    return join_null_safe(df, sized(split), [key])


def rows_of_split(df: DataFrame, split: DataFrame, name: str, key: str = "machine_id") -> DataFrame:
    return df.join(sized(split.where(F.col("split") == name)), key, "left_semi")


def holdout(df: DataFrame, key: Column, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_holdout``, decided by a seeded hash of ``key`` so reruns agree."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return df.withColumn("is_holdout", bucket < F.lit(share))


def walk_forward_folds(
    df: DataFrame, order: list[str], n_folds: int, gap: int = 0
) -> DataFrame:
    """One row per (row, fold) that uses it: ``fold_id``, ``role`` train or test, ``position``.

    Every fold trains on a growing prefix and tests on the next block after
    ``gap`` rows.
    """
    if n_folds < 1 or gap < 0:
        raise ValueError("n_folds must be positive and gap not negative")
    require(df, order)
    placed = with_position(df, order)
    n = placed.count()
    if n < n_folds * 2 + gap * n_folds:
        raise ValueError(f"{n} rows cannot form {n_folds} folds with gap {gap}")
    block = n // (n_folds + 1)
    at = F.col("position")
    roles = []
    for fold in range(n_folds):
        train_end = n - (n_folds - fold) * block
        start = train_end + gap
        role = F.when(at < train_end, "train").when(
            (at >= start) & (at < min(start + block, n)), "test"
        )
        roles.append(F.struct(F.lit(fold).alias("fold_id"), role.alias("role")))
    return placed.select("*", F.inline(F.array(*roles))).where(F.col("role").isNotNull())

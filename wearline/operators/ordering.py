"""Global order positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.session import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position of each row in the total order of ``order``.

    Rows are range-partitioned and sorted, then written once to reliable
    storage: the range bounds are sampled, so a recomputed pass could place rows
    differently. Per-partition counts (one row per partition) give the offsets.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_mid", _ROW_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    index = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # at most one row per shuffle partition
        .select(*df.columns, (F.col("_offset") + index).alias(name))
    )

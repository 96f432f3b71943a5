"""Running totals per key that never put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# rows that one window partition holds about, at most
BLOCK_ROWS = 500_000


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int, name: str) -> DataFrame:
    """Add ``name``: the total of ``value`` over the rows of the key before this one.

    The order is pseudorandom but fixed: rows of a key are spread by a hash of
    ``order`` over so many blocks that a key with all ``rows`` rows makes blocks
    of about ``BLOCK_ROWS``; a block starts where the blocks before it end.
    ``order`` must tell the rows of a key apart.
    """
    blocks = max(8, -(-rows // BLOCK_ROWS))
    valued = df.withColumn("_v", value.cast("bigint")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sums = valued.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        valued.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0)))
        .join(bases, [*keys, "_b"])
        .withColumn(name, F.col("_base") + F.col("_w"))
        .drop("_v", "_b", "_w", "_base")
    )

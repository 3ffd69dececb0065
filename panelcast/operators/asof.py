"""As-of join of two tables: each left row takes the last right row of its key up to its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.sinks import kept


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, values: list[str], right_time: str, before: bool = False) -> DataFrame:
    """left with values and right_time of the last row of right (on, right_time, values) not after time, or before it; null without one.

    Of right rows of one key and time the one with the greatest values counts. A row with a null key or time meets nothing. Both sides
    are dealt by ranges of key and time, so that a key of any size is spread over tasks; within a range the last right row is carried
    over, and what a range ends with is carried to the next ones of the key.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(on))]
    taken = [right_time, *values]
    known = F.lit(True)
    for c in (*on, time):
        known = known & F.col(c).isNotNull()
    held = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(taken)])
    a = left.where(known).select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(time).alias("_t"), F.lit(0 if before else 1).alias("_side"), F.struct(*left.columns).alias("_l"))
    ready = F.lit(True)
    for c in (*on, right_time):
        ready = ready & F.col(c).isNotNull()
    b = right.where(ready).select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(right_time).alias("_t"), F.lit(1 if before else 0).alias("_side"), held.alias("_r"))
    rows = a.unionByName(b, allowMissingColumns=True)
    # stored, as the number of a range must stay what it was
    rows = kept(rows.repartitionByRange(parts, *keys, "_t", "_side").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *keys).orderBy("_t", "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_own", F.last("_r", True).over(own)).where("_l is not null").drop("_r")
    ends = rows.groupBy("_part", *keys).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).alias("_end"))
    carry = F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    found = met.join(ends.withColumn("_carry", carry).drop("_end"), ["_part", *keys], "left").withColumn("_r", F.coalesce("_own", "_carry"))
    out = found.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_r")[f"_{i}"].alias(c) for i, c in enumerate(taken)])
    return out.unionByName(left.where(~known), allowMissingColumns=True)

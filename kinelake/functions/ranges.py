"""Running totals in one order over all rows, without a window that all rows pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.runtime import cut


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """rows with, for each name in sums, the sum of its column over all rows before this one in the order (0 before the first; equal rows in any order).

    Rows are dealt to ranges of the order, cut there, and summed up by range; the only window without a key is over one row per range.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_by{i}" for i in range(len(order))]
    parts = {name: f"_of_{name}" for name in sums}
    held = rows.select("*", *[c.alias(k) for k, c in zip(keys, order, strict=True)], *[c.alias(parts[name]) for name, c in sums.items()])
    dealt = cut(held.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(p).alias(p) for p in parts.values()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(totals.select("_range", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"_start_{name}") for name, p in parts.items()]))
    within = W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    made = dealt.join(F.broadcast(starts), "_range")  # n rows
    made = made.select("*", *[(F.col(f"_start_{name}") + F.coalesce(F.sum(p).over(within), F.lit(0))).alias(name) for name, p in parts.items()])
    return made.drop("_range", *keys, *parts.values(), *[f"_start_{name}" for name in sums])

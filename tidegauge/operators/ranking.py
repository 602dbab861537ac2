"""Ranks and exact quantiles of large groups without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.materialize import cut


def value_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, low, n): each distinct value with the number of smaller rows of its key and the rows of the key.

    Ties are counted first. The distinct values are then dealt out by range, so a large key spans many partitions; running
    counts inside a partition plus the totals of the partitions before it give the ranks.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    dealt = cut(counts.repartitionByRange(key, value).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("upto", F.sum("c").over(inside))
    totals = dealt.groupBy("part", key).agg(F.sum("c").alias("total"))
    by_part = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.withColumn("offset", F.sum("total").over(by_part) - F.col("total")).withColumn("n", F.sum("total").over(Window.partitionBy(key)))
    return local.join(offsets.drop("total"), ["part", key]).select(key, value, (F.col("offset") + F.col("upto") - F.col("c")).alias("low"), (F.col("offset") + F.col("upto")).alias("high"), "n")


def quantile_grid(ranks: DataFrame, key: str, value: str, points: int) -> DataFrame:
    """(key, i, q): quantiles at i / (points - 1) by linear interpolation of the empirical distribution, made monotone.

    With f = p n and k = max(ceil(f) - 1, 0): x[0] if k = 0, else t x[k-1] + (1 - t) x[k] with t = k + 1 - f.
    """
    steps = points - 1
    n = F.col("n").cast("double")
    span = F.sequence(
        F.greatest(F.lit(0), (F.floor(F.col("low") * steps / n) - 1).cast("int")),
        F.least(F.lit(steps), (F.ceil((F.col("high") + 1) * steps / n) + 1).cast("int")),
    )
    f = F.col("i") / F.lit(float(steps)) * n
    k = F.greatest(F.ceil(f) - 1, F.lit(0))
    spread = ranks.withColumn("i", F.explode(span)).withColumn("f", f).withColumn("k", k)
    at = lambda r: (F.col("low") <= r) & (r < F.col("high"))
    here, below = at(F.col("k")), at(F.col("k") - 1)
    ends = spread.where(here | below).groupBy(key, "i").agg(F.max(F.when(here, F.col(value))).alias("x1"), F.max(F.when(below, F.col(value))).alias("x0"), F.max("f").alias("f"), F.max("k").alias("k"))
    t = F.col("k") + 1 - F.col("f")
    q = F.when(F.col("k") == 0, F.col("x1")).otherwise(t * F.col("x0") + (1 - t) * F.col("x1"))
    raised = F.max("q").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ends.select(key, "i", q.alias("q")).select(key, "i", raised.alias("q"))

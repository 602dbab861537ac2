"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points neighbours at the smallest node of their neighbourhood.

    The minimum is a partial aggregate and the join repeats a node once for each of its links, so a hub is dealt out
    as any skewed join side; no task gathers a neighbourhood.
    """
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = links.unionByName(back) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = sides.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = sides.join(lowest, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node that is reachable.

    Null ends and self-links are left out; repeated links and either direction count once; an empty table gives an empty
    result. Each round is written to the shared checkpoint folder. The number of rounds grows with the logarithm of the
    longest path; max_rounds is a guard that raises, never one that stops early.
    """
    links = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = cut(_star(_star(links, large=True), large=False))
        if (after := _state(links)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

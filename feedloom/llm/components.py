"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut

FEW = 1 << 18  # edges up to which a round is three shuffles (a few MB), all edges of a node in one task


def _marked(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, tuple]:
    """The edges as kept, and their count and checksum, seen while they are written."""
    seen = Observation()
    kept = keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    found = seen.get
    return kept, (found["n"], found["sum"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and each neighbour below it are linked to the least of these; all edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """Both stars in one round for few edges: minima are taken over a node's edges where they lie, not joined back."""
    least = F.min("v").over(Window.partitionBy("u"))
    both = edges.select("u", "v").union(edges.select("v", "u"))
    large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = large.withColumn("m", least).select("m", F.explode(F.array("u", "v")).alias("u"))
    return small.where("u <> m").select("u", F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(id, component) of every node that is not the least of its component.

    Rounds go on until the edges stay the same; all that comes to the driver is their count and
    checksum. Neighbours are aggregated, never gathered, so a node with very many links is a
    skewed join at most; rounds on up to FEW edges take fewer shuffles. Self links and nulls are dropped, repeated links count once. `keep` writes
    the edges of a round and gives them back.
    """
    least, most = F.least(a, b), F.greatest(a, b)
    now, mark = _marked(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(most.alias("u"), least.alias("v")).distinct(), keep
    )
    before = None
    while mark != before and mark[0]:
        before = mark
        now, mark = _marked(_stars(now) if mark[0] <= FEW else _small_star(_large_star(now)), keep)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))

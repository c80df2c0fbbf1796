"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MOST_COMMON, materialize


def _lowest(edges: DataFrame, total: int) -> DataFrame:
    """(u, v) -> u, m, parts: the lowest of u and its neighbours, pre-aggregated before the shuffle, and over how many
    parts u's edges are dealt. A part holds about ``total / MOST_COMMON`` edges, so there are at most ``MOST_COMMON``
    nodes of several parts, and twice as many parts of them."""
    parts = F.least(F.col("n"), F.ceil(F.col("n") * MOST_COMMON / total)).cast("long")
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return low.select("u", F.least("u", "m").alias("m"), parts.alias("parts"))


def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(u, v) -> u, v, m. The edges of a node around which a large group gathers do not meet in one task."""
    hubs = low.where("parts > 1").select("u", "parts")
    dealt = edges.join(F.broadcast(hubs), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("part"))
    each = low.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(each, ["u", "part"]).select("u", "v", "m")


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> node, component: the lowest node that each linked node reaches.

    Every round makes each node point at the lowest node around it; a path
    shortens by a constant factor a round. A round's edges go to the shared
    folder, so that neither the plan nor what is lost with an executor grows.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(now, "links")
    stamp = _stamp(now)
    for _ in range(most_rounds):
        total = stamp[0]
        if not total:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # repeated edges of this half do no harm; the next half drops them
        down = _with_lowest(both, _lowest(both, 2 * total)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = materialize(down, "large-star")
        low = _lowest(down, total)
        small = _with_lowest(down, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "links")
        was, stamp = stamp, _stamp(now)
        if stamp == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: a forest of stars, every edge from a node to its lowest
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))

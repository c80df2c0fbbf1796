"""Connected components against a plain union-find: chains, stars whose centre is any of their nodes, repeated links."""

import random

from pyspark.sql import functions as F

from meterwright.llm import _graph


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: top(x) for x in up}


def found(spark, edges):
    rows = _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def check(spark, edges):
    got, want = found(spark, edges), brute(edges)
    # the lowest node of a component may or may not have a row of its own
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}


def test_chain_and_odd_links(spark):
    check(spark, [(k, k + 1) for k in range(40)] + [(100, 100), (7, 6), (7, 6)])
    assert found(spark, []) == {}


def test_stars_with_centres_anywhere(spark):
    rng = random.Random(3)
    edges = [(5000, k) for k in range(20_000) if k != 5000]  # centre in the middle
    edges += [(99_999, k) for k in range(30_000, 33_000)] + [(40_000, k) for k in range(40_001, 43_000)]  # highest, lowest
    edges += [(rng.randrange(50_000, 54_000), rng.randrange(50_000, 54_000)) for _ in range(3000)]
    rng.shuffle(edges)
    check(spark, edges)


def test_a_large_star_is_dealt_over_parts(spark):
    edges = spark.range(1, 30_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _graph._lowest(edges, 60_000).cache()
    assert low.where("parts > 1").select("u", "parts").collect() == [(0, 5000)]
    joined = _graph._with_lowest(edges, low)
    assert joined.count() == 60_000 and joined.where("m <> 0").count() == 0

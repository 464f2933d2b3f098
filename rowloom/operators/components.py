"""Connected groups of a graph of links, by alternating large and small stars with written rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.runtime import Scratch


def _in_one_task(edges: pd.DataFrame) -> pd.DataFrame:
    """Smallest id of every vertex's component, of a bounded number of edges."""
    up: dict = {}

    def top(x):  # noqa: ANN001, ANN202
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for z in path:
            up[z] = x
        return x

    for a, b in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    ids = list(up)
    return pd.DataFrame({"id": ids, "group": [top(x) for x in ids]})


def connected(edges: DataFrame, left: str, right: str, scratch: Scratch, *, in_task: int = 1_000_000) -> DataFrame:
    """(id, group): every end of an edge with the smallest id it is linked to. Null ends and loops link nothing.

    Every round links the neighbours of a vertex to its smallest neighbour, first the larger, then the smaller ones; the
    number of rounds grows with the logarithm of the longest chain. A vertex with very many neighbours is only ever
    aggregated (a minimum), never collected. Up to ``in_task`` edges are linked by one task instead, with the same result.
    """
    e = edges.where(f"`{left}` <> `{right}`").select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).distinct()
    e = scratch.cut(e)
    if e.count() <= in_task:
        kind = dict(e.dtypes)["u"]
        return scratch.cut(e.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_in_one_task, f"id {kind}, `group` {kind}"))
    seen = None
    while True:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("u", "v", "m")
        nxt = small.select(F.col("m").alias("u"), "v").unionByName(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        nxt = scratch.cut(nxt)
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(e)
        e = nxt
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
    return e.select(F.col("v").alias("id"), F.col("u").alias("group")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("group")).distinct())

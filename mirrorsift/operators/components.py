"""Connected components of an undirected graph given as edges, at any size.

Each round every node points at the neighbour (or itself) that comes first in that round's random order;
edges are then rewritten to the nodes pointed at.  The order is a fresh hash per round, so chains shrink
by a constant factor a round whatever their ids.  Per-node work is a ``min`` with map-side combining and
joins against one row per node, so a hub node costs one row per task.  When few edges are left (a fixed
bound, ``SMALL``), one task finishes them with union-find.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.runtime import fewer, stage, unstage

#: Edges that one task may finish alone: 20,000 rows of two longs.
SMALL = 20_000


def union_find(a, b) -> dict:
    """Smallest id of each node's component, for edges held in memory."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    found = union_find(pdf["a"].tolist(), pdf["b"].tolist())
    return pd.DataFrame({"node": list(found.keys()), "rep": list(found.values())}).astype("int64")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is its smallest node.

    Null ends, self loops and repeated edges are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    ends = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    left = stage(fewer(ends.where("x and y and a < b").select("a", "b").distinct()), "edges")
    maps: list[DataFrame] = []
    rounds = 0
    while True:
        n = left.count()
        if n == 0:
            break
        if n <= small:
            maps.append(left.groupBy().applyInPandas(_finish, "node long, rep long"))
            break
        both = left.union(left.select("b", "a")).toDF("u", "v")
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("o"), F.col(c).alias("id"))  # noqa: E731, B023
        firsts = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        hook = stage(fewer(firsts.select(F.col("u").alias("node"), F.least("m", order("u"))["id"].alias("rep"))), "hooks")
        maps.append(hook)
        ends = left.join(hook.toDF("a", "ra"), "a").join(hook.toDF("b", "rb"), "b")
        nxt = stage(fewer(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()), "edges")
        unstage(left)
        left = nxt
        rounds += 1
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    label = maps[0]
    for step in maps[1:]:
        label = label.join(step.toDF("rep", "next"), "rep", "left").select("node", F.coalesce("next", "rep").alias("rep"))
    label = stage(label, "labels")
    least = label.groupBy("rep").agg(F.min("node").alias("component"))
    return label.join(least, "rep").select("node", "component")

"""Greedy leader clustering: in the order of ids, the first unclaimed node leads and claims its unclaimed neighbours.

A node leads if no smaller neighbour does.  Rounds settle all nodes whose smaller neighbours are settled:
nodes without a smaller open neighbour lead, and the larger neighbours of leaders are claimed.  A claimed
node belongs to its smallest leading neighbour.  Rounds are joins, so no block has to fit in a task; when
few open edges are left, one task finishes them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.operators.components import SMALL
from mirrorsift.runtime import stage


def leaders_of(edges: list[tuple]) -> list:
    """Leaders among the nodes of edges (a, b) with a < b."""
    smaller: dict = {}
    nodes = set()
    for a, b in edges:
        smaller.setdefault(b, []).append(a)
        nodes.update((a, b))
    lead: set = set()
    for n in sorted(nodes):
        if not any(a in lead for a in smaller.get(n, ())):
            lead.add(n)
    return sorted(lead)


def leader_clusters(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(leader, member, similarity) for the members of clusters of two or more; the leader comes with 100.

    edges: a, b (a < b) and similarity, one row for each pair that is similar enough.
    """
    edges = stage(edges.select("a", "b", "similarity"), "leader-edges")
    kind = dict(edges.dtypes)["a"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": leaders_of(list(zip(pdf["a"], pdf["b"], strict=True)))})

    left, lead = edges.select("a", "b"), None
    while (n := left.count()) > 0:
        if n <= small:
            found, left = stage(left.groupBy().applyInPandas(finish, f"node {kind}"), "leaders"), left.limit(0)
        else:
            found = stage(left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")), "node", "left_anti"), "leaders")
            claimed = left.join(found.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
            gone = stage(found.union(claimed), "settled")
            rest = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
            open_before = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(gone, "node", "left_anti")
            left = stage(rest.select("a", "b"), "open-edges")
            alone = open_before.join(left.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_anti")
            found = stage(found.union(alone), "leaders")
        lead = found if lead is None else lead.union(found)
    if lead is None:
        return edges.select(F.col("a").alias("leader"), F.col("b").alias("member"), "similarity").limit(0)
    lead = stage(lead.distinct(), "all-leaders")
    claims = edges.join(lead.withColumnRenamed("node", "a"), "a", "left_semi").join(lead.withColumnRenamed("node", "b"), "b", "left_anti")
    best = claims.groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("m")).select(F.col("m.a").alias("leader"), F.col("b").alias("member"), F.col("m.similarity").alias("similarity"))
    best = stage(best, "members")
    return best.unionByName(best.select("leader", F.col("leader").alias("member"), F.lit(100.0).alias("similarity")).distinct())

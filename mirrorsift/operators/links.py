"""Links between the members of buckets, without making the pairs of a bucket.

A round elects a few heads of each bucket and tests every other member against them, but only members that
are not yet connected to the head.  Heads that met all members leave the bucket; buckets whose members are
all connected are done.  A bucket of copies so costs one test a member however large it is, and no pair that
could join two components is left untested: the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.operators.components import connected_components
from mirrorsift.runtime import stage, unstage

#: Heads a bucket in the first round, and the factor by which they grow: real groups are joined by the first.
HEADS, GROWTH = 1, 8


def bucket_links(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], heads: int = HEADS, growth: int = GROWTH) -> DataFrame:
    """(a, b, similarity), a < b: links that connect all that any verified pairs of one bucket connect.

    keys: key, id (longs).  verify: takes pairs (a, b) and returns those that are linked, with similarity.
    """
    spark = keys.sparkSession
    edges = spark.createDataFrame([], "a long, b long, similarity double")
    tested = part = None
    past: list[DataFrame] = []
    open_ = keys.where("key is not null and id is not null").select("key", "id").distinct()
    width, turn = heads, 0
    while True:
        labelled = open_.withColumn("part", F.col("id")) if part is None else open_.join(part, "id", "left").select("key", "id", F.coalesce("part", "id").alias("part"))
        several = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        labelled = stage(labelled.join(several, "key", "left_semi"), "open-buckets")
        for table in past:
            unstage(table)
        if labelled.isEmpty():
            unstage(labelled)
            return edges
        slot = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(width))
        first = labelled.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("id", "part")).alias("h"))
        first = stage(first.select("key", F.col("h.id").alias("head"), F.col("h.part").alias("head_part")), "bucket-heads")
        pairs = labelled.join(first, "key").where("part <> head_part").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "tested-pairs")
        found = stage(verify(pairs).select("a", "b", F.col("similarity").cast("double").alias("similarity")), "linked-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            part = connected_components(edges).toDF("id", "part")
        past = [labelled, first]
        open_ = labelled.join(first.select("key", F.col("head").alias("id")), ["key", "id"], "left_anti").select("key", "id")
        width, turn = width * growth, turn + 1

"""Exact duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.functions.text import content_hash


def exact_groups(df: DataFrame, digest: Column | None = None, prefix_chars: int | None = None, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """group_id (the smallest member), the member, similarity 100 and match_type 'exact', for groups of two or more.

    The digest is that of the whole text unless given, or of a prefix.  Null and empty digests are no group.
    Groups are counted with map-side combining and joined back: a hot digest splits over tasks.
    """
    digest = content_hash(F.col(text_col), prefix_chars) if digest is None else digest
    hashed = df.select(F.col(id_col), digest.alias("digest")).where("digest is not null and digest <> ''")
    groups = hashed.groupBy("digest").agg(F.min(id_col).alias("group_id"), F.count("*").alias("n")).where("n > 1").select("digest", "group_id")
    return hashed.join(groups, "digest").select("group_id", id_col, F.lit(100.0).alias("similarity"), F.lit("exact").alias("match_type"), F.col("digest").alias("content_hash"))


def representatives(df: DataFrame, groups: DataFrame, id_col: str = "path") -> DataFrame:
    """df with one member of each exact group."""
    later = groups.where(F.col("group_id") != F.col(id_col)).select(id_col)
    return df.join(later, id_col, "left_anti")


def without_members(df: DataFrame, groups: DataFrame, id_col: str = "path") -> DataFrame:
    """df without any member of an exact group."""
    return df.join(groups.select(id_col), id_col, "left_anti")

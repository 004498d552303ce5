"""Mixing sources to target weights by Poisson replication, in SQL functions only.

A source with target weight w and n of the N documents gets the mean repetition rate w * N / n.  Each
document draws a uniform number from a hash of the seed and its doc_id and inverts the Poisson
distribution of its source's rate with it; it is emitted once per count, and the copies are dealt over
partitions and ordered by another hash: a shuffle that is global and repeatable.  Only the count of each
source is aggregated; a hot source costs a row per task.

Rates above MAX_RATE are drawn as a sum of equal parts, each with a hash of its own, so that exp(-rate)
stays a normal number.  Defined results: a null source is a source of its own (weights give it under
None); sources without a weight in a given mapping have rate 0; documents with equal doc_id get equal
counts; a row without a doc_id is drawn and ordered by a hash of all its columns, so only equal rows among
those get equal counts; null texts are copied as they are; extra columns are kept; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.runtime import stage, unused

MAX_RATE = 32.0
#: Terms of the distribution function that are kept: beyond 160 the tail at rate 32 is under 1e-50.
TERMS = 160


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, source_col: str = "source") -> DataFrame:
    """source, rate, parts, cdf: one row per source.

    weights are relative target weights by source; without them a source's weight is its count to ``power``.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = stage(counts.withColumn("w", weight), "source-counts")
    total, whole = counts.agg(F.sum("n"), F.sum(F.expr("cast(w as decimal(38, 12))")).cast("double")).first()
    rated = counts.withColumn("rate", F.col("w") * F.lit(total or 0) / F.lit(whole) / F.col("n") if whole else F.lit(0.0))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int")))
    rated = rated.withColumn("part_rate", F.col("rate") / F.col("parts"))
    first = F.exp(-F.col("part_rate"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("part_rate") / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("part_rate") / k)).alias("cdf"),
    )
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(first.alias("p"), F.array(first).alias("cdf")), step, lambda acc: acc["cdf"])
    # a uniform number is under 1, so values that round to 1 are never passed
    return rated.select("mix_source", "rate", "parts", F.filter(cdf, lambda c: c < 1).alias("cdf"))


def poisson_mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None,
) -> DataFrame:
    """The rows of docs, each repeated as drawn, with n_copies, copy (from 1) and order_key, in shuffled order.

    order_key orders each partition; partition and order together are a random permutation of all copies.
    """
    spark = docs.sparkSession
    table = stage(rates(docs, weights, power, source_col), "rates")
    own = docs[id_col].cast("string")
    key = F.coalesce(own, F.md5(F.to_json(F.struct(*(docs[c] for c in docs.columns)))))
    drawn = docs.join(table, docs[source_col].cast("string").eqNullSafe(table["mix_source"]))
    draws = F.transform(F.sequence(F.lit(1), table["parts"]), lambda i: uniform(F.lit(str(seed)), i.cast("string"), key))
    count = F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter(table["cdf"], lambda c: c <= u)))
    clash = [c for c in ("n_copies", "copy", "order_key") if c in docs.columns]
    kept = [c for c in docs.columns if c not in clash]
    row = unused("row_key", docs.columns)
    drawn = drawn.select(*(docs[c] for c in kept), key.alias(row), count.alias("n_copies")).where("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("copy").cast("string"), F.col(row))), 1, 16)
    copies = copies.select(*(F.col(f"`{c}`") for c in kept), "n_copies", "copy", order.alias("order_key"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(n, F.col("order_key")).sortWithinPartitions("order_key")


#: The query's counts in DuckDB: sqrt weights, seed 0, one part a source (rates stay under MAX_RATE there).
ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS total, CAST(sum(CAST(w AS DECIMAL(38, 12))) AS DOUBLE) AS weights FROM counts),
rate AS (SELECT source, w * total / weights / n AS r FROM counts, whole),
cdf AS (
  SELECT source, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM rate
  UNION ALL
  SELECT source, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k < 60),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(s.cs, lambda c: c <= CAST('0x' || substr(md5('0:1:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0)) AS m
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, CAST(m AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
  substr(md5('0-order:' || copy || ':' || doc_id), 1, 16) AS order_key
FROM (SELECT *, unnest(range(1, m + 1)) AS copy FROM drawn WHERE m > 0)
"""

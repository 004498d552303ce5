"""The driver's tables as file records: documents as text files, embeddings as images and video frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorsift.functions import hashes
from mirrorsift.runtime import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; what reads it in Arrow batches gets bounded ones."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: the extension follows the language, mtime is doc_id hours."""
    ending = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".md").when(F.col("lang") == "fr", ".rst").otherwise(".log")
    name = F.concat(F.format_string("doc_%06d", "doc_id"), ending)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), name).alias("path"), name.alias("name"), F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 3600.0).cast("double").alias("mtime"), ending.alias("extension"), "source", "lang", "text",
    )


#: The same in DuckDB.
FILES = """f AS (SELECT doc_id, source || '/' || name AS path, name, size, mtime, extension, source, lang, text FROM (
  SELECT *, printf('doc_%06d', doc_id) || extension AS name FROM (
    SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CAST(doc_id * 3600.0 AS DOUBLE) AS mtime, source, lang, text,
      CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.md' WHEN 'fr' THEN '.rst' ELSE '.log' END AS extension FROM documents)))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 grey images: two bit hashes, over the mean and over the median; synthetic sizes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    bits = e.withColumn("ahash", hashes.above(F.col("embedding"), hashes.mean_of(F.col("embedding")))).withColumn("phash", hashes.above(F.col("embedding"), hashes.median_of(F.col("embedding"))))
    a, p = hashes.halves(F.col("ahash")), hashes.halves(F.col("phash"))
    return bits.select(
        "vec_id", "label", F.format_string("img_%06d.png", "vec_id").alias("path"), (F.col("vec_id") * 37 % 5000 + 500).alias("size"), (F.col("vec_id") % 7 * 100 + 100).alias("width"),
        (F.col("vec_id") % 5 * 100 + 100).alias("height"), "ahash", "phash", a[0].alias("a1"), a[1].alias("a2"), p[0].alias("p1"), p[1].alias("p2"),
    )


IMAGES = """img AS (SELECT vec_id, label, printf('img_%06d.png', vec_id) AS path,
  array_to_string(list_transform(e, lambda x: CASE WHEN x > list_sum(e) / len(e) THEN '1' ELSE '0' END), '') AS ahash,
  array_to_string(list_transform(e, lambda x: CASE WHEN x > list_median(e) THEN '1' ELSE '0' END), '') AS phash
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"""


def videos(spark: SparkSession, sf_dir: str, frames: int = 5) -> DataFrame:
    """Runs of embeddings as videos: a 36-bit hash a frame, from the first 36 numbers over their mean; synthetic sizes and durations."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 36).alias("v"))
    bits = e.select("vec_id", F.conv(hashes.above(F.col("v"), hashes.mean_of(F.col("v"))), 2, 10).cast("long").alias("frame"))
    ordered = F.array_sort(F.collect_list(F.struct("vec_id", "frame")))
    v = bits.groupBy(F.floor(F.col("vec_id") / frames).cast("long").alias("video_id")).agg(F.transform(ordered, lambda x: x["frame"]).alias("frames"))
    return v.select("video_id", "frames", F.format_string("vid_%06d.mp4", "video_id").alias("path"), (F.col("video_id") % 40 + 100).alias("size"), (F.col("video_id") % 90).cast("double").alias("duration"))


VIDEOS = """fr AS (SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > list_sum(e) / len(e) THEN '1' ELSE '0' END), '') AS bits
  FROM (SELECT vec_id, list_transform(embedding[1:36], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
runs AS (SELECT CAST(vec_id // 5 AS BIGINT) AS video_id, string_agg(bits, '' ORDER BY vec_id) AS bits, count(*) AS n FROM fr GROUP BY 1),
vid AS (SELECT *, printf('vid_%06d.mp4', video_id) AS path, CAST(trunc(log10(video_id % 40 + 101) * 10) AS INTEGER) AS size_key,
  CASE WHEN video_id % 90 = 0 THEN -1 ELSE CAST(trunc(video_id % 90 / 30.0::DOUBLE) AS INTEGER) END AS duration_key FROM runs)"""

"""Incremental duplicate detection over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.functions.text import content_hash


def first_seen(stream: DataFrame, time_col: str = "mtime_ts", delay: str = "7 days", text_col: str = "text") -> DataFrame:
    """The stream without texts already seen within the watermark; state is one hash a text and expires."""
    return stream.withColumn("content_hash", content_hash(F.col(text_col))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def against_known(batch: DataFrame, known: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """For foreachBatch: the batch's rows with the smallest known path of an equal text, null where it is new.

    known is the stored table (content_hash, path); append the new rows to it after each batch.
    """
    first = known.groupBy("content_hash").agg(F.min("path").alias("duplicate_of"))
    return batch.withColumn("content_hash", content_hash(F.col(text_col))).join(first, "content_hash", "left")

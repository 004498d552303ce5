"""Candidate pairs and their prescreens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.functions import files, text
from mirrorsift.functions.shingles import band_keys
from mirrorsift.runtime import again, configure, spread, stage

FEATURES = ("size", "line_count", "first_lines_hash", "last_lines_hash", "word_sample", "stem_chars")


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the character sets of two names without their extensions; 0 where one is empty."""
    chars = lambda c: text.characters(files.stem(F.lower(c)))
    x, y = chars(a), chars(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def with_features(df: DataFrame, empty_head: bool = False) -> DataFrame:
    """path, size and the features that the quick check reads; texts are not carried on."""
    f = text.line_features(F.col("text"), empty_head)
    return df.select(
        "path", "name", "extension", "size", f["line_count"].alias("line_count"), f["first_lines_hash"].alias("first_lines_hash"), f["last_lines_hash"].alias("last_lines_hash"),
        text.word_sample(F.col("text")).alias("word_sample"), text.characters(files.stem(F.lower(F.col("name")))).alias("stem_chars"),
    )


def sized_gates(a: str, b: str) -> Column:
    """Size, name and line ratios that rule a pair out."""
    col = lambda t, c: F.col(f"{t}.{c}")
    size = files.ratio(col(a, "size"), col(b, "size"))
    lines = files.ratio(col(a, "line_count"), col(b, "line_count"))
    shared = F.size(F.array_intersect(col(a, "stem_chars"), col(b, "stem_chars"))) / F.nullif(F.size(F.array_union(col(a, "stem_chars"), col(b, "stem_chars"))), F.lit(0))
    named = (col(a, "name") == col(b, "name")) | (F.coalesce(shared, F.lit(0.0)) >= 0.3) | (size >= 0.9)
    return (size >= 0.8) & named & ((col(a, "line_count") == 0) | (col(b, "line_count") == 0) | (lines >= 0.7))


def rarest_first(features: DataFrame) -> DataFrame:
    """path and word: of each sample its rarest words, so many that samples over half alike share one of them.

    In the order of rarity the shared words of two samples are the rarest that can be, so common words are
    keys only of samples that hold nothing else.
    """
    words = features.select("path", F.size("word_sample").alias("n"), F.explode("word_sample").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("files"))
    ranked = words.join(often, "word").groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("files", "word"))).alias("w"))
    return ranked.select("path", F.explode(F.slice("w", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))).alias("x")).select("path", F.col("x.word").alias("word"))


def quick_pairs(features: DataFrame, *block: str) -> DataFrame:
    """(a, b), a < b: pairs with an equal head, an equal tail, or samples of words with a Jaccard over 0.5.

    The alternatives are a union of equi-joins, each with its own key, so none is a nested loop.
    """
    a, b = features.alias("a"), features.alias("b")
    same = lambda *cs: [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*block, *cs)]

    def under(conditions: list[Column]) -> Column:
        out = F.col("a.path") < F.col("b.path")
        for c in conditions:
            out = out & c
        return out & sized_gates("a", "b")

    heads = a.join(b, under(same("first_lines_hash"))).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"))
    tails = a.join(b, under(same("last_lines_hash"))).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"))
    keyed = stage(features.join(rarest_first(features), "path"), "sample-words")
    ka, kb = keyed.alias("a"), again(keyed).alias("b")
    alike = F.size(F.array_intersect("a.word_sample", "b.word_sample")) / F.size(F.array_union("a.word_sample", "b.word_sample")) > 0.5
    word = ka.join(kb, under(same("word")) & alike).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"))
    return heads.union(tails).union(word).distinct()


#: MinHash bands and minima a band: two texts that share half their shingles meet with a probability of 0.96.
BANDS, ROWS = 24, 3


def shingle_keys(df: DataFrame, id_col: str = "path", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, id: the MinHash buckets of each text."""
    return df.select(F.col(id_col).alias("id"), F.explode(band_keys(F.col(text_col), bands, rows)).alias("key")).select("key", "id")


def shingle_candidates(df: DataFrame, id_col: str = "path", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(head, id): the members of each bucket of two texts or more with its smallest, a row a member and head.

    This is the first round of links.bucket_links(), which goes on with the members that do not match their head.
    """
    configure(df.sparkSession)
    keyed = stage(shingle_keys(spread(df.select(id_col, text_col)), id_col, text_col, bands, rows), "shingle-keys")
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(heads, "key").where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()

"""The two calls of the public API, scan and find_duplicates, and the near-duplicate plans behind them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorsift.functions import files, hashes, matchers, text
from mirrorsift.operators import blocking, exact, leaders, pairs
from mirrorsift.operators.components import connected_components
from mirrorsift.operators.links import bucket_links
from mirrorsift.params import Params
from mirrorsift.runtime import again, configure, spread, stage
from mirrorsift.sources import scan as sources

GROUPS = "group_id string, path string, similarity double, match_type string"


def scan(spark: SparkSession, roots: Iterable[str], kind: str = "text", params: Params = Params(), metadata: DataFrame | None = None, cache: str | None = None) -> DataFrame:
    """Files of a kind under the roots, as find_duplicates() takes them.

    Texts come with their encoding and text; images with width, height, format, mode and both hashes (a1, a2, p1,
    p2); videos with width, height, fps, frame_count, duration and the hashes of their sampled frames.
    metadata: facts of videos from an outside decoder.  cache: a folder that keeps fingerprints by path and mtime.
    """
    roots = list(roots)
    if kind == "video":
        found = sources.dealt(stage(sources.scan_directories(spark, roots, kind, extensions=params.extensions), "scanned"))
        known = sources.with_video_info(found, metadata)
        longest = F.lit(True) if params.max_duration is None else F.col("duration") <= params.max_duration
        return sources.with_frames(known.where((F.col("duration") >= params.min_duration) & longest), roots, params.sample_frames, cache)
    least = params.min_file_size if kind == "text" else None
    found = stage(sources.scan_directories(spark, roots, kind, min_size=least, max_size=params.max_file_size, extensions=params.extensions), "scanned")
    found = sources.dealt(found)
    return sources.with_text(found) if kind == "text" else sources.with_image_hashes(sources.with_image_info(found), roots, cache)


def scored_pairs(texts: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates at or over the threshold.  texts: id, path and t, a normalised text.

    The matcher is not symmetric: the text with the smaller path always comes first.
    """
    both = candidates.join(texts.toDF("a", "pa", "ta"), "a").join(texts.toDF("b", "pb", "tb"), "b")
    ordered = F.col("pa") <= F.col("pb")
    first, second = F.when(ordered, F.col("ta")).otherwise(F.col("tb")), F.when(ordered, F.col("tb")).otherwise(F.col("ta"))
    second_id = F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("second_id")
    # dealt by number after the joins, whose few partitions would be the matcher's; a text that is second often is prepared once
    both = spread_pairs(both.select("a", "b", first.alias("first"), second.alias("second"), second_id))
    return both.select("a", "b", matchers.text_similarity(F.col("first"), F.col("second"), threshold).alias("similarity")).where(F.col("similarity") >= threshold)


def pieces(spark: SparkSession) -> int:
    """Tasks of heavy work on few bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_pairs(pairs_: DataFrame) -> DataFrame:
    """Pairs in runs of one second text, each text's dealt over a few tasks."""
    return pairs_.repartition(pieces(pairs_.sparkSession), "second_id", F.pmod(F.xxhash64("a", "b"), F.lit(4))).sortWithinPartitions("second_id")


def grouped(members: DataFrame) -> DataFrame:
    """group_id, path, similarity of members (path, component, best): 100 for the first path of a component, else the best edge."""
    first = members.groupBy("component").agg(F.min("path").alias("group_id"))
    return members.join(first, "component").select("group_id", "path", F.when(F.col("path") == F.col("group_id"), F.lit(100.0)).otherwise(F.col("best")).alias("similarity"))


def component_groups(edges: DataFrame) -> DataFrame:
    """group_id, path, similarity of connected paths: 100 for the first path, else the best edge of the member.

    Paths get dense numbers by a join, so no two paths are ever one node.
    """
    edges = stage(edges.select("a", "b", "similarity"), "edges")
    best = edges.select(F.explode(F.array("a", "b")).alias("path"), "similarity").groupBy("path").agg(F.max("similarity").alias("best"))
    nodes = stage(best.withColumn("node", F.monotonically_increasing_id()), "nodes")
    ids = nodes.select("path", "node")
    linked = edges.join(ids.toDF("a", "na"), "a").join(again(nodes).select("path", "node").toDF("b", "nb"), "b")
    return grouped(nodes.join(connected_components(linked, "na", "nb"), "node"))


def compat_candidates(df: DataFrame, most_pairs: int = 10_000) -> DataFrame:
    """(a, b) that the shipped plan matches: size and extension blocks; over 100 files those near in time; over 500
    the selection; batches of 50 in that order with the shipped head rule, until over ``most_pairs`` pairs are held."""
    kept = stage(blocking.text_blocks(df.drop("text")), "blocks")
    order: tuple = ("path",)
    if kept.count() > 100:
        kept, order = stage(blocking.near_in_time(kept), "near-in-time"), ("mtime", "path")
    if kept.count() > 500:
        kept, order = stage(blocking.smart_selection(kept, rank="_rank"), "selection"), ("_rank", "mtime", "path")
    batched = stage(blocking.batches(kept, *order).select("path", "batch"), "batches")
    features = pairs.with_features(df.join(batched, "path", "left_semi"), empty_head=True).join(batched, "path")
    found = stage(pairs.quick_pairs(stage(features, "features"), "batch").join(batched.select(F.col("path").alias("a"), "batch"), "a"), "batch-pairs")
    counts = found.groupBy("batch").agg(F.count("*").alias("n"))
    before = blocking.running_sum(counts, "n", "batch").where(F.col("before") <= most_pairs).select("batch")
    return found.join(before, "batch", "left_semi").select("a", "b")


def find_text_duplicates(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Exact and similar groups of text files (path, name, extension, size, mtime, text)."""
    return _compat_duplicates(df, params) if params.compat else _text_duplicates(df, params)


def _compat_duplicates(df: DataFrame, params: Params) -> DataFrame:
    df = stage(spread(df.select("path", "name", "extension", "size", "mtime", "text")), "files")
    same = stage(exact.exact_groups(df, prefix_chars=params.hash_prefix_chars or 100_000).drop("content_hash"), "exact")
    rest = exact.without_members(df, same)
    candidates = stage(compat_candidates(rest), "candidates")
    texts = rest.select(F.col("path").alias("id"), "path", text.normalize(F.col("text"), 50_000).alias("t"))
    similar = component_groups(scored_pairs(texts, candidates, params.similarity_threshold))
    return same.unionByName(similar.withColumn("match_type", F.lit("similar")))


def text_links(files_: DataFrame, threshold: float, skip: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): links of the texts of files_ (id, path, size, text) that share a MinHash bucket.

    Two texts are linked if they share a bucket, their sizes lie within a factor of 0.8 and they score the
    threshold or more.  Only texts that share a bucket with another are carried on; skip is a table of ids to
    leave out, which are taken from the keys, so that no other text travels.
    """
    configure(files_.sparkSession)
    keys = pairs.shingle_keys(files_, "id")
    keys = stage(keys if skip is None else keys.join(skip, "id", "left_anti"), "shingle-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = stage(again(keys).join(shared, "key", "left_semi"), "shared-keys")
    near = files_.join(keys.select("id").distinct(), "id", "left_semi")
    texts = stage(near.select("id", "path", "size", text.normalize(F.col("text")).alias("t")), "candidate-texts")
    sizes = texts.select("id", "size")

    def verify(candidates: DataFrame) -> DataFrame:
        sized = candidates.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b").where(files.ratio(F.col("sa"), F.col("sb")) >= 0.8)
        return scored_pairs(texts.select("id", "path", "t"), sized.select("a", "b"), threshold)

    return bucket_links(keys, verify)


def _text_duplicates(df: DataFrame, params: Params) -> DataFrame:
    """Groups of copies and groups of similar files that share a file are one."""
    # ids are fixed by writing them; texts are read where they lie and only candidates' texts move
    df = stage(spread(df.select("path", "size", "text")).withColumn("id", F.monotonically_increasing_id()), "files")
    digest = text.content_hash(F.col("text"), params.hash_prefix_chars)
    hashed = stage(df.select("id", "path", digest.alias("digest")).where("digest is not null"), "digests")
    firsts = hashed.groupBy("digest").agg(F.min(F.struct("path", "id")).alias("m"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("m.id").alias("rep"))
    copies = stage(hashed.join(firsts, "digest").select("id", "rep"), "copies")
    later = copies.where("id <> rep").select("id")
    edges = stage(text_links(df.select("id", "path", "size", "text"), params.similarity_threshold, later), "text-links")
    same = copies.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("similarity"))
    links = same.unionByName(edges)
    parts = connected_components(links).toDF("id", "component")
    best = links.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.max("similarity").alias("best"))
    kind = F.when(F.col("copy"), F.lit("exact")).otherwise(F.lit("similar")).alias("match_type")
    members = stage(parts.join(best, "id").join(copies.select("id", F.lit(True).alias("copy")), "id", "left").select("id", "component", "best", kind), "members")
    named = again(members).join(df.select("id", "path"), "id")
    first = named.groupBy("component").agg(F.min("path").alias("group_id"))
    score = F.when(F.col("path") == F.col("group_id"), F.lit(100.0)).otherwise(F.col("best")).alias("similarity")
    return named.join(first, "component").select("group_id", "path", score, "match_type")


def distinct_hashes(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(firsts, members): one row for each distinct fingerprint, named by its first path, and path, first of all files.

    Files of one fingerprint have the same distances, so a leader that takes one takes all: only first paths
    are compared, however many copies there are.
    """
    hashed = stage(df.select("path", *keys), "fingerprints")
    firsts = stage(hashed.groupBy(*keys).agg(F.min("path").alias("first")), "first-fingerprints")
    same = F.lit(True)
    for k in keys:
        same = same & hashed[k].eqNullSafe(firsts[k])
    return firsts.withColumnRenamed("first", "path"), hashed.join(firsts, same).select(hashed["path"], "first")


def image_edges(images: DataFrame, params: Params = Params(), block: str | None = None) -> DataFrame:
    """(a, b, similarity) of images in one block whose mean distance of both hashes is within the threshold."""
    most = min(64, max(0, int(64 * (1 - params.similarity_threshold / 100))))
    key = blocking.image_key() if block is None else F.col(block)
    # hashes are made once, not once a pair, and dealt evenly: a block may be hot, and pairs are made where its rows lie
    i = stage(images.select("path", key.alias("block"), "a1", "a2", "p1", "p2").where("a1 is not null and p1 is not null"), "image-hashes")
    a, b = salted(i, "a"), salted(again(i), "b", spread_out=True)
    h = lambda t, k: (F.col(f"{t}.{k}1"), F.col(f"{t}.{k}2"))
    mean = (hashes.hamming(h("a", "a"), h("b", "a")) + hashes.hamming(h("a", "p"), h("b", "p"))) / 2
    near = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.path") < F.col("b.path")) & (mean <= most))
    return near.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), ((1 - mean / 64) * 100).alias("similarity"))


#: Parts of a block: each row of one side has one, the other side's rows meet all of them, so a hot block is this many tasks.
SALTS = 16


def salted(df: DataFrame, name: str, spread_out: bool = False) -> DataFrame:
    """df (block, path) in parts of blocks, dealt by number: rows are few bytes and their pairs are many, so the
    partitions that Spark would join by bytes are the tasks of the pairs."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))) if spread_out else F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    return df.withColumn("salt", salt).repartition(pieces(df.sparkSession), "block", "salt").alias(name)


def video_edges(videos: DataFrame, params: Params = Params(), denominator: str = "bits", block: str | None = None) -> DataFrame:
    """(a, b, similarity) of videos (path, frames, block columns) at or over the threshold."""
    key = blocking.video_key() if block is None else F.col(block)
    v = stage(videos.select("path", key.alias("block"), "frames").where("frames is not null"), "video-hashes")
    a, b = salted(v, "a"), salted(again(v), "b", spread_out=True)
    most = v.agg(F.max(F.size("frames"))).first()[0]
    score = hashes.frame_similarity(F.col("a.frames"), F.col("b.frames"), denominator=denominator, most=most)
    near = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.path") < F.col("b.path")) & (score >= params.similarity_threshold))
    return near.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), score.alias("similarity"))


def fingerprint_groups(found: DataFrame, edges_of, *keys: str) -> DataFrame:
    """leader, member, similarity of greedy leader clusters; edges_of makes the edges of rows with distinct fingerprints."""
    firsts, members = distinct_hashes(found, *keys)
    clusters = stage(leaders.leader_clusters(edges_of(firsts)), "clusters")
    copies = members.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first")
    # groups of equal fingerprints that no other group takes are led by their first path
    alone = copies.join(clusters.select(F.col("member").alias("first")), "first", "left_anti")
    whole = clusters.unionByName(alone.select(F.col("first").alias("leader"), F.col("first").alias("member"), F.lit(100.0).alias("similarity")))
    return whole.withColumnRenamed("member", "first").join(members, "first").select("leader", F.col("path").alias("member"), "similarity")


def find_duplicates(found: DataFrame, kind: str = "text", params: Params = Params()) -> DataFrame:
    """group_id, path, similarity, match_type of the duplicate groups of scanned files of a kind.

    Images and videos are compared inside blocks of like size and extent, as scan() describes them; files
    without a fingerprint are in no group.
    """
    if kind == "text":
        return find_text_duplicates(found, params)
    if kind == "image":
        i = found.withColumns({"size_block": F.floor(F.col("size") / 1024), "width_block": F.floor(F.coalesce("width", F.lit(0)) / 100), "height_block": F.floor(F.coalesce("height", F.lit(0)) / 100)})
        keys = ("size_block", "width_block", "height_block")
        blocked = blocking.with_partner(i.where("a1 is not null"), *(F.col(k) for k in keys))
        clusters = fingerprint_groups(blocked, lambda x: image_edges(x.withColumn("block", F.struct(*keys)), params, "block"), *keys, "a1", "a2", "p1", "p2")
    else:
        v = found.where("frames is not null").withColumn("size_key", blocking.video_size_key(F.col("size"))).withColumn("duration_key", blocking.video_duration_key(F.col("duration")))
        keys = ("size_key", "duration_key")
        denominator = "rows" if params.compat else "bits"
        blocked = blocking.with_partner(v, *(F.col(k) for k in keys))
        clusters = fingerprint_groups(blocked, lambda x: video_edges(x.withColumn("block", F.struct(*keys)), params, denominator, "block"), *keys, "frames")
    return clusters.select(F.col("leader").alias("group_id"), F.col("member").alias("path"), "similarity", F.lit("similar").alias("match_type"))


def similarity_details(pairs_: DataFrame, a: str = "ta", b: str = "tb") -> DataFrame:
    """pairs_ with sequence_similarity, vocabulary_similarity and structure_similarity (percent) of two text columns.

    Vocabularies are the words between spaces and line ends; two texts without words, or a null text, score 0.
    """
    ta, tb = F.col(a), F.col(b)
    word_set = lambda c: F.array_distinct(F.filter(F.split(c, "[ \n]+"), lambda x: x != ""))
    scores = {
        "sequence_similarity": F.when(ta.isNull() | tb.isNull(), F.lit(0.0)).otherwise(matchers.seq_ratio(F.coalesce(ta, F.lit("")), F.coalesce(tb, F.lit("")))),
        "vocabulary_similarity": F.coalesce(100 * text.jaccard(word_set(ta), word_set(tb)), F.lit(0.0)),
        "structure_similarity": F.coalesce(100 * text.cosine(text.sentence_vector(ta), text.sentence_vector(tb)), F.lit(0.0)),
    }
    return pairs_.withColumns(scores)

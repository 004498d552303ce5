"""What follows from duplicate groups: keepers, action plans, summaries, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorsift.functions import files
from mirrorsift.operators.blocking import numbered, positions
from mirrorsift.runtime import stage

#: Strategy: the column to order by and whether the largest comes first.
STRATEGIES = {"largest": ("char_count", True), "resolution": ("pixels", True), "smallest": ("size", False), "smallest_displayed": ("size", False), "newest": ("mtime", True), "oldest": ("mtime", False)}
ACTIONS = ("trash", "backup", "copy", "delete")


def keepers(members: DataFrame, strategy: str = "largest", manual: DataFrame | None = None) -> DataFrame:
    """members with ``keep``: one kept path a group, by strategy; ties go to the first path.

    'manual' takes paths from a table (column path); an unknown strategy keeps the first path.  The winner
    is an aggregate with map-side combining joined back, so a large group is never sorted in one task.
    """
    if strategy == "manual":
        if manual is None:
            raise ValueError("manual keeping needs the chosen paths")
        chosen = manual.select("path").distinct().withColumn("keep", F.lit(True))
        return members.join(chosen, "path", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    column, largest = STRATEGIES.get(strategy, (None, False))
    value = F.lit(0) if column is None else F.coalesce(F.col(column), F.lit(0))
    if strategy == "smallest_displayed":  # sizes that look alike are ties
        value = files.parse_size(files.format_size(value, files.SIZE_UNITS[:5]))
    rank = F.struct((-value if largest else value).alias("o"), F.col("path"))
    best = members.groupBy("group_id").agg(F.min(rank).alias("m")).select("group_id", F.col("m.path").alias("_kept"))
    return members.join(best, "group_id").withColumn("keep", F.col("path") == F.col("_kept")).drop("_kept")


def action_plan(kept: DataFrame, action: str, folder: str = "", existing: DataFrame | None = None) -> DataFrame:
    """path, action, target, group_id for every member that is not kept.  A plan: nothing is touched.

    Groups without a keeper are left out.  backup and copy need a folder.  There the first path of a name keeps
    it and the others get the first free of _1, _2, ... in the order of paths: a name is taken if another planned
    file has it from the start or it stands in existing (a table name of what the folder holds).  So no two
    files ever get one target.
    """
    if action not in ACTIONS:
        raise ValueError(f"actions are {', '.join(ACTIONS)}")
    if action in ("backup", "copy") and not folder:
        raise ValueError("a target folder is needed")
    safe = kept.groupBy("group_id").agg(F.max("keep").alias("any")).where("any").select("group_id")
    gone = kept.where(~F.col("keep")).join(safe, "group_id", "left_semi")
    if action in ("trash", "delete"):
        return gone.select("path", F.lit(action).alias("action"), F.lit(None).cast("string").alias("target"), "group_id")
    return free_names(gone.select("path", "group_id"), existing).select("path", F.lit(action).alias("action"), F.concat(F.lit(folder.rstrip("/") + "/"), "target").alias("target"), "group_id")


def free_names(files_: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """files_ (path, ...) with target: a name of its own for each, close to the file's name.

    The k-th copy of a name gets the k-th free number.  Copies and taken numbers of a name are put in one order,
    a taken number t before the copies from the t-th on, and a copy's number is its place in it.  Places come
    from ranges over all names, so a name that very many files share is no single task.
    """
    named = files_.withColumn("_name", files.basename(F.col("path")))
    placed = stage(positions(named, "_name", "path", name="_rank"), "named")
    held = placed.select(F.col("_name").alias("name")).distinct()
    there = held.limit(0) if existing is None else existing.select("name").distinct()
    first = placed.join(there.select(F.col("name").alias("_name"), F.lit(1).alias("_there")), "_name", "left").withColumn("_copy", F.col("_rank") - 1 + F.coalesce("_there", F.lit(0)))
    first = stage(first.drop("_rank", "_there"), "ranked-names")
    copies = first.where("_copy > 0")
    # names of the form stem_t.extension take the number t of stem.extension
    numbered_name = r"^(.+)_([1-9][0-9]{0,17})(\.[^.]*)?$"
    taken = held.union(there).distinct().where(F.col("name").rlike(numbered_name)).select(
        F.concat(F.regexp_extract("name", numbered_name, 1), F.regexp_extract("name", numbered_name, 3)).alias("_name"), F.regexp_extract("name", numbered_name, 2).cast("long").alias("t")
    )
    taken = taken.join(copies.select("_name").distinct(), "_name", "left_semi")
    freed = positions(taken, "_name", "t", name="j").select("_name", (F.col("t") - F.col("j")).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("path"))
    events = copies.select("_name", F.col("_copy").alias("v"), F.lit(0).alias("kind"), "path").unionByName(freed)
    # a taken number counts for the copies after the t - j free ones that lie under it
    numbers = positions(events, "_name", "v", "kind", "path", name="_n").where("kind = 0").select("path", "_n")
    out = first.join(numbers, "path", "left")
    ending = F.regexp_extract("_name", r"^.+?(\.[^.]*)$", 1)
    target = F.when(F.col("_n").isNull(), F.col("_name")).otherwise(F.concat(files.stem(F.col("_name")), F.lit("_"), F.col("_n").cast("string"), ending))
    return out.select(*files_.columns, target.alias("target"))


def validate(paths: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing, missing) paths against a listing."""
    return paths.join(listing.select("path").distinct(), "path", "left_semi"), paths.join(listing.select("path").distinct(), "path", "left_anti")


def total_size(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Bytes of the paths that exist."""
    return listing.select("path", "size").dropDuplicates(["path"]).join(paths.select("path"), "path", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def scan_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def summary(groups: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Number of groups and of their files; with the scanned files, the files' share of them in percent."""
    counts = groups.agg(F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_files"))
    if scanned is None:
        return counts
    total = scanned.agg(F.count("*").alias("_total"))
    return counts.join(total).select("n_groups", "n_files", F.coalesce(100 * F.col("n_files") / F.nullif("_total", F.lit(0)), F.lit(0.0)).alias("rate"))


def throughput(stats: DataFrame, seconds: float) -> DataFrame:
    """scan_stats() with the mean size of a file and files and megabytes a second."""
    per = lambda c, n: F.coalesce(F.col(c) / F.nullif(n, F.lit(0)), F.lit(0.0))
    spent = F.lit(float(seconds))
    return stats.select("*", per("total_size", F.col("total_files")).alias("avg_size"), per("total_files", spent).alias("files_per_sec"), (per("total_size", spent) / 1048576).alias("mb_per_sec"))


def export(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Write results as parquet, csv (with a header) or json, replacing what is there."""
    if form not in ("parquet", "csv", "json"):
        raise ValueError("results are written as parquet, csv or json")
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def reclaimable(members: DataFrame) -> DataFrame:
    """Bytes of all members but the first of each group."""
    return members.where(F.col("path") != F.col("group_id")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def results_view(members: DataFrame, kind: str = "text") -> DataFrame:
    """Display rows: group number in the order of group ids, path, size, two details and similarity as text."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    if kind == "text":
        first, second = known("line_count"), known("char_count")
    else:
        first = F.concat_ws("x", known("width"), known("height"))
        second = known("format") if kind == "image" else files.format_duration(F.col("duration"))
    order = numbered(members.select("group_id").distinct(), "group_id", name="group_no")
    return members.join(order, "group_id").select(
        "group_no", "path", files.format_size(F.col("size"), files.SIZE_UNITS[:5]).alias("size_text"), first.alias("detail_1"), second.alias("detail_2"),
        F.concat(files.one_decimal(F.coalesce("similarity", F.lit(100.0))), F.lit("%")).alias("similarity_text"),
    )

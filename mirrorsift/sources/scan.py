"""File scans: folders are listed level by level in tasks, contents are read only where they are used."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mirrorsift.functions import files, matchers
from mirrorsift.functions.hashes import hash_frames, hash_pixels
from mirrorsift.runtime import again, configure, stage
from mirrorsift.sources import media

#: Bytes of contents that a worker holds before it hands them on.
BATCH_BYTES = 16 << 20
EXTENSIONS = {"text": files.TEXT_EXTENSIONS, "image": files.IMAGE_EXTENSIONS, "video": files.VIDEO_EXTENSIONS}
# Names of folders that are not walked into, besides those that start with a dot.
PRUNED = ("__pycache__", "node_modules", ".git", ".svn", "build", "dist", "target", "bin", "obj")


def with_extension(extensions: Iterable[str], extra: str) -> frozenset[str]:
    """A set with one extension more, lower-cased; it must start with a dot."""
    if not extra.startswith("."):
        raise ValueError("an extension starts with a dot")
    return frozenset(extensions) | {extra.lower()}


def without_extension(extensions: Iterable[str], gone: str) -> frozenset[str]:
    return frozenset(extensions) - {gone.lower()}


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path inside it, and what to put before such a path to name it again."""
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, "" if path.startswith("file:") else path.split("://")[0] + "://"


def is_pruned(name: str) -> bool:
    return name.startswith(".") or name.lower() in PRUNED


def _list(frames: Iterator[pd.DataFrame], prune: bool) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for folder in pdf["folder"]:
            store, inner, before = _opened(folder)
            for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                folder_too = x.type == fs.FileType.Directory
                if not (folder_too and prune and is_pruned(x.base_name)):
                    rows.append((before + x.path, folder_too, x.size, None if x.mtime_ns is None else x.mtime_ns / 1e9))
        yield pd.DataFrame(rows, columns=["path", "is_folder", "length", "mtime"]).astype({"length": "Int64", "mtime": "float64", "is_folder": "bool"})


def list_files(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """path, length, mtime of every file under root: one job a folder level, folders listed by tasks.

    Hidden and underscored files are listed too, which Spark's own sources leave out.
    """
    folders = spark.createDataFrame([(root.rstrip("/") or "/",)], "folder string")
    out = None
    while True:
        level = stage(folders.mapInPandas(lambda x: _list(x, prune), "path string, is_folder boolean, length long, mtime double"), "listing")
        files_here = level.where("not is_folder").select("path", "length", "mtime")
        out = files_here if out is None else out.unionByName(files_here)
        below = level.where("is_folder").select(F.col("path").alias("folder"))
        if below.isEmpty():
            return out
        folders = below.repartition(spark.sparkContext.defaultParallelism)


def scan_directory(spark: SparkSession, root: str, kind: str = "text", min_size: int | None = None, max_size: int | None = 50 << 20, extensions: Iterable[str] | None = None) -> DataFrame:
    """path, name, size, mtime and extension of the files of a kind under root, in any depth; contents are not read.

    Text files have 10 bytes at least; video files have no size bounds and no folder is pruned for them.
    A root that does not exist gives no rows.
    """
    out = list_files(spark, root, prune=kind != "video").where(files.has_extension(F.col("path"), extensions or EXTENSIONS[kind]))
    if kind != "video":
        out = out.where(F.col("length") >= (10 if kind == "text" and min_size is None else min_size or 0))
        out = out if max_size is None else out.where(F.col("length") <= max_size)
    return out.select("path", files.basename(F.col("path")).alias("name"), F.col("length").alias("size"), "mtime", files.suffix(F.col("path")).alias("extension"))


def scan_directories(spark: SparkSession, roots: Iterable[str], kind: str = "text", **bounds) -> DataFrame:
    """All roots together; a file under two of them is listed once."""
    out = None
    for root in roots:
        one = scan_directory(spark, root, kind, **bounds)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "path string, name string, size long, mtime double, extension string")
    return out.dropDuplicates(["path"])


#: Files that one task opens: a listing has many to a partition, and reading them is what takes long.
FILES_A_TASK = 5000


def dealt(scanned: DataFrame) -> DataFrame:
    """A staged scan dealt over tasks of at most about FILES_A_TASK files, and over all cores."""
    n = scanned.count()
    return scanned.repartition(max(scanned.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_A_TASK)))


def _read(scanned: DataFrame, columns: str, make) -> DataFrame:
    """scanned with the columns that make(open file) returns, one file at a time; files that cannot be read are left out.

    A batch is handed on once it holds BATCH_BYTES, so a worker never holds more than that and one file.
    """
    names = scanned.columns
    schema = T.StructType([*scanned.schema.fields, *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, made, held = [], [], 0

            def out() -> pa.RecordBatch:
                cols = [c.take(pa.array(kept, type=pa.int64())) for c in batch.columns]  # noqa: B023
                more = [pa.array([m[i] for m in made], type=f.type) for i, f in enumerate(list(arrow)[len(names) :])]  # noqa: B023
                return pa.RecordBatch.from_arrays([*cols, *more], names=arrow.names)

            for i, path in enumerate(batch.column(names.index("path")).to_pylist()):
                try:
                    store, inner, _ = _opened(path)
                    with store.open_input_file(inner) as f:
                        values = make(f)
                except OSError:
                    continue
                kept.append(i)
                made.append(values)
                held += sum(len(v) for v in values if isinstance(v, (bytes, str)))
                if held >= BATCH_BYTES:
                    yield out()
                    kept, made, held = [], [], 0
            if kept:
                yield out()

    configure(scanned.sparkSession)
    return scanned.mapInArrow(run, schema)


def with_content(scanned: DataFrame, most: int | None = None) -> DataFrame:
    """The scan with the bytes of each file (at most the first ``most``); files that cannot be read are left out."""
    return _read(scanned, "content binary", lambda f: (f.read() if most is None else f.read(most),))


def decoded(data: bytes) -> tuple[str, str]:
    """(encoding, text) of a whole file: UTF-8 if all of it is, else by its first 1024 bytes; bytes that do not decode are left out."""
    try:
        return "utf-8", data.decode("utf-8")
    except UnicodeDecodeError:
        name = matchers.encoding_of(data[:1024], whole=len(data) <= 1024)
        return name, data.decode(name, "ignore")


def with_text(scanned: DataFrame) -> DataFrame:
    """The scan with its encoding and decoded text; contents never leave the task that reads them."""
    return _read(scanned, "encoding string, text string", lambda f: decoded(f.read()))


def with_image_info(scanned: DataFrame) -> DataFrame:
    """The scan with width, height, format and mode, from the headers; files that are no such image stay, with nulls."""
    return _read(scanned, "width int, height int, format string, mode string", media.image_header)


def with_video_info(scanned: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """The scan with width, height, fps, frame_count and duration.

    metadata: a table path, width, height, fps, frame_count of an outside decoder; without it the headers of AVI
    and MP4 files are read.  What neither knows is 0, and frames and duration are estimated from the size.
    """
    fields = ("width", "height", "fps", "frame_count")
    if metadata is None:
        both = _read(scanned, "width int, height int, fps double, frame_count long", media.video_header)
    else:
        both = scanned.join(metadata.select("path", *fields).dropDuplicates(["path"]), "path", "left").select(*scanned.columns, *fields)
    known = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in fields})
    count, duration = files.video_metadata(F.col("size"), F.col("fps"), F.col("frame_count"))
    return known.withColumns({"frame_count": count, "duration": duration})


# -- pixels ----------------------------------------------------------------------------------------


def _plain(path: Column) -> Column:
    """A path without scheme and host, which sources write in different ways."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _glob(extensions: Iterable[str]) -> str:
    either = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
    return "*.{" + ",".join("".join(map(either, e[1:])) for e in sorted(extensions)) + "}"


def _existing(spark: SparkSession, roots: Iterable[str]) -> list[str]:
    conf, out = spark._jsc.hadoopConfiguration(), []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).exists(path):
            out.append(root)
    return out


def pixels(spark: SparkSession, roots: Iterable[str]) -> DataFrame | None:
    """path (plain), height, width, n_channels, data of the images under the roots that Spark's image source decodes."""
    there = _existing(spark, roots)
    if not there:
        return None
    source = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", _glob(files.IMAGE_EXTENSIONS))
    image = source.load(there).select("image.*")
    return image.select(_plain(F.col("origin")).alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")


def _hashed(images: DataFrame, make, schema: str) -> Column:
    @F.pandas_udf(schema)
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        return make(pd.DataFrame({"height": height, "width": width, "n_channels": channels, "data": data}))

    return run("height", "width", "n_channels", "data")


IMAGE_HASHES = "path string, ahash long, phash long"


def image_hashes(spark: SparkSession, *roots: str, only: DataFrame | None = None) -> DataFrame:
    """path, ahash, phash of the images under the roots; only: a table of the (plain) paths to hash."""
    configure(spark)
    found = pixels(spark, roots)
    if found is None:
        return spark.createDataFrame([], IMAGE_HASHES)
    found = found if only is None else found.join(only.select("path").distinct(), "path", "left_semi")
    return found.select("path", _hashed(found, hash_pixels, "ahash long, phash long").alias("h")).select("path", "h.*").dropDuplicates(["path"])


def halves(hash_: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(hash_, 32), hash_.bitwiseAND(F.lit(0xFFFFFFFF))


def with_image_hashes(found: DataFrame, roots: Iterable[str], cache: str | None = None) -> DataFrame:
    """found with a1, a2, p1, p2 (halves of both hashes); nulls where the image could not be decoded."""
    spark, roots = found.sparkSession, list(roots)
    plain = found.withColumn("_plain", _plain(F.col("path")))
    keyed = plain.select(F.col("_plain").alias("path"), "mtime")
    made = cached(keyed, lambda some: image_hashes(spark, *roots, only=some), cache, "images") if cache else image_hashes(spark, *roots)
    made = made.select(F.col("path").alias("_plain"), "ahash", "phash")
    (a1, a2), (p1, p2) = halves(F.col("ahash")), halves(F.col("phash"))
    return plain.join(made, "_plain", "left").select(*found.columns, a1.alias("a1"), a2.alias("a2"), p1.alias("p1"), p2.alias("p2"))


FRAME = r"^(.*)\.frames/0*([0-9]+)\.[^./]+$"


def frame_hashes(spark: SparkSession, roots: Iterable[str], n: int = 5, skip_ends: bool = True, side: int = 6, only: DataFrame | None = None) -> DataFrame:
    """path, frames: the perceptual hashes of the sampled frames of each video, in order.

    The frames of video v are the images v.frames/<number>.<extension>, as an outside decoder wrote them, in
    any number format.  Which are sampled is known from their names; frames that do not decode are left out,
    and videos without any have no row.  side 6 makes one long a frame; side 8 (with skip_ends=False) is the
    slow variant over the whole video.
    """
    configure(spark)
    found = pixels(spark, roots)
    if found is None:
        return spark.createDataFrame([], "path string, frames array<bigint>")
    found = found.where(F.col("path").rlike(FRAME)).withColumn("video", F.regexp_extract("path", FRAME, 1)).withColumn("frame", F.regexp_extract("path", FRAME, 2).cast("long"))
    if only is not None:
        found = found.join(only.select(F.col("path").alias("video")).distinct(), "video", "left_semi")
    total = found.groupBy("video").agg((F.max("frame") + 1).alias("total"))
    wanted = total.select("video", F.explode(F.array_distinct(files.frame_indices(F.col("total"), n, skip_ends))).alias("frame"))
    some = found.join(wanted, ["video", "frame"]).dropDuplicates(["video", "frame"])
    make = lambda x: hash_frames(x, side)
    hashed = some.select("video", "frame", _hashed(some, make, "phash long").alias("h"))
    # at most n frames a video
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col("h.phash").alias("phash"))))
    return hashed.groupBy(F.col("video").alias("path")).agg(F.transform(ordered, lambda x: x["phash"]).alias("frames"))


def with_frames(found: DataFrame, roots: Iterable[str], n: int = 5, cache: str | None = None) -> DataFrame:
    """Scanned videos with the hashes of their sampled frames; null where there are none."""
    spark, roots = found.sparkSession, list(roots)
    plain = found.withColumn("_plain", _plain(F.col("path")))
    keyed = plain.select(F.col("_plain").alias("path"), "mtime")
    made = cached(keyed, lambda some: frame_hashes(spark, roots, n, only=some), cache, f"videos-{n}") if cache else frame_hashes(spark, roots, n)
    return plain.join(made.withColumnRenamed("path", "_plain"), "_plain", "left").select(*found.columns, "frames")


# -- stored fingerprints ---------------------------------------------------------------------------


def cached(keyed: DataFrame, make, folder: str, label: str) -> DataFrame:
    """What make(rows) gives for each path, from the table in ``folder`` where it is stored for that path and mtime.

    make takes the rows (path, mtime) that are not stored and returns path and fingerprints; they are appended.
    The label holds the parameters, so other parameters are other tables.  clear_cache() forgets them.
    """
    spark = keyed.sparkSession
    target = f"{folder.rstrip('/')}/{label}"
    keyed = stage(keyed.dropDuplicates(["path"]), "fingerprint-keys")
    missing = keyed.join(spark.read.parquet(target).select("path", "mtime"), ["path", "mtime"], "left_anti") if _existing(spark, [target]) else keyed
    missing = stage(missing, "missing-fingerprints")
    if not missing.isEmpty() or not _existing(spark, [target]):
        make(missing).join(again(missing), "path").write.mode("append").parquet(target)
    return spark.read.parquet(target).join(keyed, ["path", "mtime"], "left_semi").drop("mtime").dropDuplicates(["path"])


def clear_cache(spark: SparkSession, folder: str) -> None:
    """Delete the stored fingerprints of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

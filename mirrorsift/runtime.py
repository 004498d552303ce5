"""Session plumbing shared by every operator: shared folders, staged tables, session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches carry whole documents, so they are bounded by rows and, where Spark knows how, by bytes.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches for this session; harmless to repeat."""
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local folder in tests."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="mirrorsift-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer pieces than there are cores, dealt over all of them; any other as it is.

    Work per text is heavier than moving it, and a single row group cannot be split.  Only plain scans are
    looked at, so no query runs to answer this; a large input has more pieces than cores and is never moved.
    """
    sc = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Join", "Aggregate", "Window", "Sort", "Repartition", "Limit", "Generate")):
        return df
    cores = sc.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(name: str, columns) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/mirrorsift/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    A staged table has file statistics, so joins against it broadcast only when it is small.  small: a table of
    few bytes a row and few rows is written by as many tasks as there are cores, not a file a shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df = df.coalesce(spark.sparkContext.defaultParallelism) if small else df
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def fewer(df: DataFrame) -> DataFrame:
    """A table of few bytes a row, dealt by a shuffle without hot keys, in at most a piece a core or 16 shuffle partitions.

    Shuffle partitions that AQE does not join are a file each, however small, and without its native library Hadoop
    forks the executor for each file in a local folder, to change its mode.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)))


def again(df: DataFrame) -> DataFrame:
    """A second reader of a staged table, with columns of its own: both sides of a join may come from one table."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._staged_path)
    out._staged_path = df._staged_path
    return out


def clear_stages(spark: SparkSession) -> None:
    """Delete every table that stage() has written under the shared folder; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mirrorsift")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Delete the files of a table made by stage()."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

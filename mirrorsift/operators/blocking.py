"""Prefilters that keep only records which have a possible partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorsift.runtime import stage

DAY = 86_400.0


def with_partner(df: DataFrame, *keys: Column, least: int = 2) -> DataFrame:
    """The rows whose keys are shared by ``least`` rows or more.

    Keys are counted with map-side combining and joined back, so a hot key is a row per task and no
    window has to hold its rows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    shared = keyed.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    shared = shared.toDF(*(f"{n}r" for n in names), "_n")
    same = None
    for n in names:
        one = F.col(n).eqNullSafe(F.col(f"{n}r"))
        same = one if same is None else same & one
    return keyed.join(shared, same, "left_semi").select(*df.columns)


def size_bucket(size: Column) -> Column:
    """The shipped bucket of a text size: saturates at 19 from 380 bytes on."""
    return (size / (size * F.lit(0.05) + 1)).cast("int")


def text_blocks(df: DataFrame, by_extension: bool = True) -> DataFrame:
    """Text files whose size bucket (and extension) another one shares."""
    some = df.where("size > 0")
    bucketed = with_partner(some, size_bucket(F.col("size")))
    return with_partner(bucketed, size_bucket(F.col("size")), F.col("extension")) if by_extension else bucketed


def near_in_time(df: DataFrame, time: str = "mtime", within: float = DAY) -> DataFrame:
    """The rows with another row less than ``within`` seconds away.

    Rows of one slot of that length are near each other; a row alone in its slot looks at the last of the
    slot before and the first of the slot after.  No global order is needed.
    """
    slotted = df.withColumn("_slot", F.floor(F.col(time) / within))
    slots = slotted.groupBy("_slot").agg(F.count("*").alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last"))
    before = slots.select((F.col("_slot") + 1).alias("_slot"), F.col("_last").alias("_before"))
    after = slots.select((F.col("_slot") - 1).alias("_slot"), F.col("_first").alias("_after"))
    around = slots.select("_slot", "_n").join(before, "_slot", "left").join(after, "_slot", "left")
    near = (F.col("_n") > 1) | (F.col(time) - F.col("_before") < within) | (F.col("_after") - F.col(time) < within)
    return slotted.join(around, "_slot").where(near).select(*df.columns)


def smart_selection(df: DataFrame, most: int = 300, least: int = 200, rank: str | None = None) -> DataFrame:
    """Whole groups of equal size, the largest groups first, until ``most`` rows are held; filled to ``least``
    with the largest files of unique size.  Ties go to the group with the first path.  Both limits are the
    feature: only the top groups and the top singles are ever ordered.  rank: a column for that order."""
    sizes = df.groupBy("size").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    top = sizes.where("n > 1").orderBy(F.desc("n"), "first").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "size"))).alias("g"))
    # at most ``most`` groups: their running sum is one small array
    step = lambda acc, x: F.when(acc["held"] >= most, acc).otherwise(F.struct((acc["held"] - x["o"]).alias("held"), F.concat(acc["out"], F.array(x["size"])).alias("out")))
    picked = stage(top.select(F.aggregate("g", F.struct(F.lit(0).cast("long").alias("held"), F.expr("array_repeat(0L, 0)").alias("out")), step).alias("r")), "picked-sizes")
    place = rank or "_rank"
    groups = df.join(picked.select(F.posexplode("r.out").alias(place, "size")), "size").select(*df.columns, F.col(place).cast("long").alias(place))
    held = picked.select("r.held").first()
    missing = least - (held[0] if held and held[0] else 0)
    if missing > 0:
        singles = df.join(sizes.where("n = 1").select("size"), "size", "left_semi").select(*df.columns).orderBy(F.desc("size"), "path").limit(missing)
        groups = groups.unionByName(singles.withColumn(place, F.lit(1 << 40) - F.col("size")))
    return groups if rank else groups.drop(place)


def running_sum(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """df with the sum of ``value`` over all rows before each in a global order, without a single-partition window:
    ranges are summed apart and shifted by the sums of those before them."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("n"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_base"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_local", local).join(before, "_part").withColumn(name, (F.col("_base") + F.col("_local") - F.col(value)).cast("long")).drop("_part", "_base", "_local")


def numbered(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """Rows numbered from 1 in a global order."""
    return running_sum(df.withColumn("_one", F.lit(1)), "_one", *order, name=name).withColumn(name, F.col(name) + 1).drop("_one")


def positions(df: DataFrame, group: str, *order: str, name: str = "position") -> DataFrame:
    """Rows numbered from 1 inside their group: numbers of the whole, less the first of the group, so a hot group spreads over tasks."""
    whole = stage(numbered(df, group, *order, name="_at"), "positions")
    first = whole.groupBy(group).agg(F.min("_at").alias("_first"))
    return whole.join(first.withColumnRenamed(group, "_own"), F.col(group).eqNullSafe(F.col("_own"))).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_own")


def batches(df: DataFrame, *order: str, size: int = 50) -> DataFrame:
    """The shipped batches: consecutive rows in runs of ``size``."""
    return numbered(df, *order, name="_row").withColumn("batch", F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row")


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def image_key() -> Column:
    return F.struct(F.floor(_zero("size") / 1024).alias("s"), F.floor(_zero("width") / 100).alias("w"), F.floor(_zero("height") / 100).alias("h"))


def image_blocks(df: DataFrame) -> DataFrame:
    return with_partner(df, image_key())


def video_size_key(size: Column) -> Column:
    return F.when(F.coalesce(size, F.lit(0)) <= 0, F.lit(-1)).otherwise((F.log10(size + 1) * 10).cast("int"))


def video_duration_key(duration: Column) -> Column:
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, F.lit(-1)).otherwise((duration / 30).cast("int"))


def video_key() -> Column:
    return F.struct(video_size_key(F.col("size")).alias("s"), video_duration_key(F.col("duration")).alias("d"))


def video_blocks(df: DataFrame) -> DataFrame:
    size, both = video_size_key(F.col("size")), video_duration_key(F.col("duration"))
    return with_partner(with_partner(df, size), size, both)

"""Joins and rankings that keep working when one key holds a large share of all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A key with more than this share of all rows is hot. There are fewer hot keys than one for each such share.
HOT_SHARE = 1 / 512
#: Bits of a row's number within its partition (``monotonically_increasing_id``).
_ROW_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``, else one in the warehouse.

    A warehouse on a machine's own disk will do only where that machine is the whole cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and (":" not in warehouse or warehouse.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_work"


def stored(df: DataFrame) -> DataFrame:
    """Worked out once and written where all executors see it, for results that several branches read.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def sliced_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[str],
    counted: DataFrame | None = None,
    share: float = HOT_SHARE,
    tasks: int | None = None,
) -> DataFrame:
    """Inner join in which hot keys of ``large`` are cut into slices, with the rows of ``small`` repeated per slice.

    Keys are counted first. One that holds more than ``share`` of all rows gets a slice for each such share, so
    that no slice of it is much larger than that; rows of other keys are joined as they are. There are fewer than
    ``1 / share`` hot keys, so the list of them is small whatever the tables hold. ``spread`` are the columns of
    ``large`` that tell its rows apart. ``counted`` has the keys and their number of rows (``_rows``) where that is known;
    otherwise ``large`` is read for it. ``tasks`` is given where few rows make many: so many tasks join, however small the rows are.
    """

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(tasks, *by) if tasks else df

    if counted is None:
        counted = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = counted.agg(F.sum("_rows").alias("all"), F.max("_rows").alias("most")).first()
    if not sizes["all"] or sizes["most"] <= sizes["all"] * share:
        return dealt(large, *keys).join(dealt(small, *keys), keys)
    least = sizes["all"] * share
    hot = counted.where(F.col("_rows") > least).select(*keys, F.ceil(F.col("_rows") / least).cast("int").alias("_slices"))
    slices = F.coalesce("_slices", F.lit(1))
    cut = large.join(F.broadcast(hot), keys, "left")
    cut = cut.withColumn("_slice", F.pmod(F.xxhash64(*spread), slices).cast("int")).drop("_slices")
    copies = small.join(F.broadcast(hot), keys, "left")
    copies = copies.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    cell = [*keys, "_slice"]
    return dealt(cut, *cell).join(dealt(copies, *cell), cell).drop("_slice")


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers 1, 2, ... within each group, by all tasks even if there is a single group.

    Rows are dealt by ranges of the full order and written; each partition is counted per group, and a row's number
    is its place in its partition and the sizes of the group's earlier partitions. Only these sizes of a
    group, one for each partition at most, meet in one task. Groups may be NULL. ``order`` must tell all rows apart. The rows
    given are read twice (once for the ranges), so what is costly to work out should be ``stored``.
    """
    full = [*(F.col(column).asc() for column in group), *order]
    placed = df.repartitionByRange(*full).sortWithinPartitions(*full)
    placed = stored(placed.withColumn("_place", F.monotonically_increasing_id()))
    part = F.struct(F.shiftright("_place", _ROW_BITS).alias("_part"), *group)
    sizes = placed.groupBy(part.alias("_cell")).agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*[F.col("_cell")[column] for column in group]).orderBy(F.col("_cell")["_part"])
    earlier = F.sum("_size").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1
    shifts = sizes.select("_cell", shift.alias("_shift"))
    numbered = placed.withColumn("_cell", part).join(shifts, "_cell")
    return numbered.withColumn(name, (F.col("_place") + F.col("_shift")).cast("long")).drop("_cell", "_place", "_shift")


def top_rows(df: DataFrame, group: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first rows of each group; Spark trims each group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)

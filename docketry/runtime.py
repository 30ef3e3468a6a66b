"""Session helpers: checkpoints, checked broadcasts, deterministic prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a keyed side table may be broadcast (a few dozen MB for the narrow tables used here).
BROADCAST_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose executors are this machine, may do without: there a temporary folder is
    set, and removed when the program ends. On a cluster a missing folder is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="docketry-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", *, salt_on: Column, limit: int = BROADCAST_ROWS, salts: int = 32
) -> DataFrame:
    """Join a skewed ``big`` with a keyed ``small`` side.

    ``small`` is materialised and counted: up to ``limit`` rows it is broadcast, beyond that it is
    replicated over ``salts`` salts and the big side is spread over them by ``salt_on``, so that one hot
    key is never read by one task.
    """
    small = materialize(small)
    if small.count() <= limit:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, salt_on=salt_on, salts=salts)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", *, salt_on: Column, salts: int = 8) -> DataFrame:
    """Join in which the rows of one key of ``big`` are spread over ``salts`` tasks, to each of which ``small`` is copied."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


def prefix_sums(
    df: DataFrame, groups: list[str], order: list[str], value: str, out: str, *, buckets: int = 256, seed: int = 0
) -> DataFrame:
    """Exclusive running sum of ``value`` inside each group in a pseudo-random, repeatable order.

    The order is by hash of ``order``, ties by ``order`` itself. The hash is cut into ``buckets`` ranges;
    a range's sum is a map-side-combined aggregate, ranges are added up on a table of groups x buckets
    rows, and only the rest runs in a window, over one range of one group. A group holding a third of
    all rows is therefore spread over ``buckets`` tasks.
    Null values count as 0.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    part = F.shiftrightunsigned(h, 32).cast("long")
    rows = df.withColumn("_h", h).withColumn("_b", F.floor(part * buckets / F.lit(2**32)).cast("int"))
    rows = rows.withColumn("_v", F.coalesce(F.col(value).cast("long"), F.lit(0)))
    w = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*groups, "_b").agg(F.sum("_v").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    inner = Window.partitionBy(*groups, "_b").orderBy(part, "_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    joined = rows.join(heads.drop("_s"), [*groups, "_b"])
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_h", "_b", "_v", "_in", "_base")


def ranged(df: DataFrame, groups: list[str], order: list[str], out: str = "_part") -> DataFrame:
    """``df`` cut into ranges of (groups, order) that follow one another, with the range's number in ``out``.

    A group of any size lies in as many ranges as its share of the rows asks for. Rows are written to the
    checkpoint folder, so that the cut is the same for every later reader. Ties may lie in two ranges, so
    ``order`` should tell all rows of a group apart.
    """
    return materialize(df.repartitionByRange(*groups, *order).withColumn(out, F.spark_partition_id()))


def rank_in_group(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Position from 1 in each group by ``order``: counted inside ranges, whose heads are added up on a table of groups x ranges."""
    cut = ranged(df, groups, order)
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut.groupBy(*groups, "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    heads = heads.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_gp"), "_base")
    inner = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_gp")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = cut.withColumn("_i", inner).join(heads, same)
    return joined.select(*df.columns, (F.col("_base") + F.col("_i")).cast("bigint").alias(out))

"""Manifests: hashing, verifying, keyed ingest, staleness, change trails, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import ranged


def hash_manifest(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha256, source_id): content hash of every row and its first 16 digits. Null content has no hash."""
    h = F.sha2(F.col(content), 256)
    return df.select(F.col(path).alias("path"), h.alias("sha256"), F.left(h, F.lit(16)).alias("source_id"))


def verify_manifest(manifest: DataFrame, disk: DataFrame, *, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, status) of every path on either side: ok, missing, hash-mismatch or untracked.

    One full outer join on the path gives all four. A null digest equals only a null digest. Paths are
    expected once on each side; repeated ones are taken with their smallest digest.
    """
    m = manifest.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("_want"), F.lit(True).alias("_m"))
    d = disk.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("_have"), F.lit(True).alias("_d"))
    status = F.when(F.col("_d").isNull(), "missing").when(F.col("_m").isNull(), "untracked").when(F.col("_want").eqNullSafe(F.col("_have")), "ok").otherwise("hash-mismatch")
    return m.join(d, key, "full_outer").select(key, status.alias("status"))


def one_per_key(df: DataFrame, key: str, order: str, *, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``: keyed ingest without and with force. Combines on the map side; null keys form one group."""
    row = F.struct(*df.columns)
    pick = F.max_by(row, F.col(order)) if last else F.min_by(row, F.col(order))
    return df.groupBy(F.col(key).alias("_key")).agg(pick.alias("_row")).select("_row.*")


def append_entries(existing: DataFrame, new: DataFrame, key: str = "source_id", *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(result, conflicts): new rows after those present; conflicts are new keys already there.

    Without ``force`` conflicting rows are left out; with it they replace the old ones.
    """
    conflicts = new.join(existing.select(key), key, "left_semi")
    if force:
        return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), conflicts
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True), conflicts


def stale(recorded: DataFrame, current: DataFrame, *, widget: str = "widget", path: str = "path", digest: str = "sha256") -> DataFrame:
    """(widget, stale): whether any input of a widget is missing from, or different to, what was recorded."""
    r = recorded.select(widget, path, F.col(digest).alias("_a"), F.lit(True).alias("_r"))
    c = current.select(widget, path, F.col(digest).alias("_b"), F.lit(True).alias("_c"))
    differ = F.col("_r").isNull() | F.col("_c").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return r.join(c, [widget, path], "full_outer").groupBy(widget).agg(F.bool_or(differ).alias("stale"))


def change_trail(df: DataFrame, *, path: str, order: list[str], blob: str) -> DataFrame:
    """Add change_type: initial until a blob was seen, then content where the blob differs from the last one seen, else rename-or-metadata.

    Histories are cut into ranges; what a range has to know of those before it is the last blob seen,
    one row per path and range, so a path with a very long history is spread over many tasks. Null paths
    form one history.
    """
    packed = df.select(F.struct("*").alias("_row"), F.col(path).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(blob).alias("_b"))
    keys = [f"_o{i}" for i in range(len(order))]
    cut = ranged(packed, ["_k"], keys)
    inner = Window.partitionBy("_k", "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    lasts = cut.groupBy("_k", "_part").agg(F.max_by("_b", F.when(F.col("_b").isNotNull(), F.struct(*keys))).alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = lasts.select(F.col("_k").alias("_hk"), F.col("_part").alias("_hp"), F.last("_last", ignorenulls=True).over(earlier).alias("_head"))
    joined = cut.withColumn("_in", F.last("_b", ignorenulls=True).over(inner)).join(heads, F.col("_k").eqNullSafe(F.col("_hk")) & (F.col("_part") == F.col("_hp")))
    before = F.coalesce("_in", "_head")
    kind = F.when(before.isNull(), "initial").when(F.col("_b").eqNullSafe(before), "rename-or-metadata").otherwise("content")
    return joined.select("_row.*", kind.alias("change_type"))


def verdict(warnings: Column, *, worst_wins: bool = False) -> Column:
    """pass, warn or fail of a list of warnings: the first decisive one decides, or the worst if asked for."""
    fail = lambda w: F.contains(w, F.lit("HASH MISMATCH"))
    if worst_wins:
        return F.when(F.exists(warnings, fail), "fail").when(F.size(warnings) > 0, "warn").otherwise("pass")
    first = F.get(warnings, F.lit(0))
    return F.when(F.size(warnings) == 0, "pass").when(fail(first), "fail").otherwise("warn")

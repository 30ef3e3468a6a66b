"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.timestamps import YEARS, normalize_timestamps
from docketry.runtime import checked_join


def hex_number(value):
    """A hexadecimal number in one spelling: 64 lower-case digits; null where it is none."""
    v = F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"\s", ""))), r"^(sha-?256:|0x)", "")
    v = F.regexp_replace(v, r"^0+(?=.)", "")
    return F.when(v.rlike("^[0-9a-f]{1,64}$"), F.lpad(v, 64, "0"))


def _order(latest: str, tie: str, kind: str):
    """Time and tie as one number, so that the aggregate keeps it in a fixed-width buffer."""
    t = F.col(latest)
    if kind == "timestamp":
        micros = F.unix_micros(t)
    else:
        micros = F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + (F.hour(t) * 60 + F.minute(t)).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    time = F.coalesce(micros.cast("decimal(18,0)"), F.lit(-(10**17)).cast("decimal(18,0)"))
    return (time * F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.coalesce(F.col(tie).cast("decimal(20,0)"), F.lit(-(2**62)).cast("decimal(20,0)"))


def consecutive_changes(
    df: DataFrame, *, group: str, number: str, key: str, latest_by: str, tie: str, compare: list[str], out: str = "change_kind"
) -> DataFrame:
    """Records added, removed or changed from each snapshot of a group to the next one present.

    A row of snapshot n is the later side of the pair (previous, n) and the earlier side of (n, next), so
    each row enters at most two pairs, tagged by side. One aggregation by (group, pair, key) tells the kind
    from the hashes of each side: a 64-bit hash for each compared column, as a column without a value on
    either side tells no difference, which one hash of the whole row could not say. Of a record repeated
    in a snapshot the row with the latest ``latest_by`` holds (ties: the largest ``tie``, an integer). All
    buffers have fixed width, so the aggregation hashes, combines on the map side, and spreads the keys of
    a hot group over all tasks. What follows what is one row per snapshot, from an aggregate over two
    columns; its size is checked before it is broadcast.

    Null groups or numbers are no snapshots; null keys form one record; a null time counts as earliest.
    The first snapshot of a group gives no rows, and neither does a group with one snapshot. Result:
    ``group``, ``number`` (of the later snapshot), ``key``, ``out``.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(number).isNotNull())
    w = Window.partitionBy(group).orderBy(number)
    chain = rows.select(group, number).distinct().select(group, number, F.lag(number).over(w).alias("_prev"), F.lead(number).over(w).alias("_next"))
    hashes = [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"_h{i}") for i, c in enumerate(compare)]
    rows = rows.select(group, number, key, _order(latest_by, tie, dict(df.dtypes)[latest_by]).alias("_at"), *hashes)
    rows = checked_join(rows, chain, [group, number], salt_on=F.col(key))
    side = F.array(
        F.when(F.col("_prev").isNotNull(), F.struct(F.col(number).alias("pair"), F.lit(True).alias("later"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("pair"), F.lit(False).alias("later"))),
    )
    names = [f"_h{i}" for i in range(len(compare))]
    tagged = rows.select(group, key, "_at", *names, F.explode(F.filter(side, lambda x: x.isNotNull())).alias("_side"))
    tagged = tagged.select(group, key, "_at", *names, "_side.pair", "_side.later")
    at = {flag: F.when(F.col("later") == flag, F.col("_at")) for flag in (True, False)}
    states = [F.max_by(h, at[flag]).alias(f"{h}{flag}") for h in names for flag in (True, False)]
    both = tagged.groupBy(group, "pair", key).agg(F.max(F.col("later").cast("int")).alias("_in_new"), F.min(F.col("later").cast("int")).alias("_all_new"), *states)
    differ = F.lit(False)
    for h in names:
        differ = differ | F.coalesce(F.col(f"{h}True") != F.col(f"{h}False"), F.lit(False))
    kind = F.when(F.col("_all_new") == 1, "added").when(F.col("_in_new") == 0, "removed").when(differ, "changed")
    return both.select(group, F.col("pair").alias(number), key, kind.alias(out)).where(F.col(out).isNotNull())


def evidence_changes(entries: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """``consecutive_changes`` for evidence trees: content hash as a hex number, mtime as an instant."""
    rows = normalize_timestamps(entries.select("entry_id", "case_id", "snapshot_no", "path", "mtime", "sha256", "loaded_at"), "mtime", out="_mtime", years=years)
    rows = rows.withColumn("_sha", F.when(F.col("sha256").isNotNull(), hex_number(F.col("sha256"))))
    return consecutive_changes(rows, group="case_id", number="snapshot_no", key="path", latest_by="loaded_at", tie="entry_id", compare=["_sha", "_mtime"])

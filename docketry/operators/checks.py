"""Checks of records: schemas, keys, packets, roles, edits, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import filled, host, label
from docketry.runtime import rank_in_group

# Roles and icons that a case map knows, and the shape of its identifiers.
ROLES = ("neutral", "adversary", "ally", "self")
ICONS = ("person", "org", "venue", "counsel")
_ID = r"^[a-z0-9][a-z0-9_-]*\z"


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(hold, F.lit(False)), F.lit(code)) for hold, code in pairs]), lambda x: x.isNotNull())


def entity_errors(entities: DataFrame, *, key: str, ident: str = "entity_id", role: str = "role", name: str = "display_name", ref: str = "ref_path", icon: str = "icon") -> DataFrame:
    """(key, code) of every rule an entity breaks: bad-id, repeated-id, bad-role, no-name-or-ref, bad-icon. A null role or id is a bad one."""
    n = entities.where(F.col(ident).isNotNull()).groupBy(ident).agg((F.count("*") > 1).alias("_again"))
    e = entities.join(n, ident, "left")
    codes = _codes(
        (~F.coalesce(F.col(ident).rlike(_ID), F.lit(False)), "bad-id"), (F.col("_again"), "repeated-id"), (~F.coalesce(F.col(role).isin(*ROLES), F.lit(False)), "bad-role"),
        (filled(F.col(name)).isNull() & filled(F.col(ref)).isNull(), "no-name-or-ref"), (filled(F.col(icon)).isNotNull() & ~F.col(icon).isin(*ICONS), "bad-icon"),
    )
    return e.select(key, F.explode(codes).alias("code"))


def unknown_keys(rows: DataFrame, known: DataFrame, *, key: str, scope: str, ids: str, ident: str) -> DataFrame:
    """(key, scope, id) of references that lead to no known row of the same scope. Null lists and null references lead nowhere and are not told."""
    asked = rows.select(key, F.col(scope).alias("_s"), F.explode(F.array_distinct(ids)).alias("_i")).where(F.col("_i").isNotNull())
    have = known.select(F.col(scope).alias("_s"), F.col(ident).alias("_i")).distinct()
    return asked.join(have, ["_s", "_i"], "left_anti").select(key, F.col("_s").alias(scope), F.col("_i").alias("id"))


def packet_errors(exhibits: DataFrame, files: DataFrame, manifest: DataFrame, *, packet: str, order: str, given: str = "label", path: str = "path", digest: str = "sha256") -> DataFrame:
    """(packet, order, code) of what is wrong in a packet: out-of-sequence labels, missing sources, stale or unlisted hashes.

    Labels must run A..Z, AA.. in the order given. ``files`` are what is there, with their digests,
    ``manifest`` what is recorded; paths are unique in both. A source that is not there has no hash to check.
    """
    e = rank_in_group(exhibits.select(packet, order, given, path), [packet], [order], "_n")
    have = files.select(path, F.col(digest).alias("_have"), F.lit(True).alias("_there"))
    want = manifest.select(path, F.col(digest).alias("_want"), F.lit(True).alias("_listed"))
    e = e.join(have, path, "left").join(want, path, "left")
    there = F.col("_there").isNotNull()
    codes = _codes(
        (~F.col(given).eqNullSafe(label(F.col("_n") - 1)), "out-of-sequence"), (~there, "missing-source"),
        (there & F.col("_listed").isNull(), "not-in-manifest"), (there & F.col("_listed").isNotNull() & ~F.col("_have").eqNullSafe(F.col("_want")), "stale-hash"),
    )
    return e.select(packet, order, F.explode(codes).alias("code"))


def packet_status(errors: DataFrame, *, packet: str) -> DataFrame:
    """(packet, exit_code, errors): 2 where sources are missing or labels wrong, else 1 for hashes; packets without errors have no row."""
    hard = F.col("code").isin("out-of-sequence", "missing-source")
    return errors.groupBy(packet).agg(F.when(F.bool_or(hard), 2).otherwise(1).alias("exit_code"), F.count("*").alias("errors"))


def sensitive_roles(threads: DataFrame, role: str, sensitive: list[str]) -> DataFrame:
    """(role): roles that both occur in the threads and are sensitive."""
    spark = threads.sparkSession
    return threads.select(F.col(role).alias("role")).intersect(spark.createDataFrame([(r,) for r in sensitive], "role string"))


def next_ids(rows: DataFrame, groups: DataFrame, *, group: str, ident: str, first: int = 0) -> DataFrame:
    """(group, next_id): one more than the largest id of every group, ``first`` for a group without rows."""
    top = rows.groupBy(group).agg(F.max(ident).alias("_m"))
    return groups.select(group).distinct().join(top, group, "left").select(group, F.coalesce(F.col("_m") + 1, F.lit(first)).cast("bigint").alias("next_id"))


def is_stub(status: Column, short: Column, name: Column) -> Column:
    """Whether a record only holds a place: status todo or stub, no short name or TODO, or todo inside the name."""
    s = F.upper(F.trim(F.coalesce(short, F.lit(""))))
    return F.lower(F.coalesce(status, F.lit(""))).isin("todo", "stub") | s.isin("", "TODO") | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("todo"))


def first_populated(rows: DataFrame, *, group: list[str], order: str, name: str, keep: list[str]) -> DataFrame:
    """Of each group the first row with a name that does not begin with TODO; groups without one have no row."""
    good = rows.where(filled(F.col(name)).isNotNull() & ~F.startswith(name, F.lit("TODO")))
    return good.groupBy(*group).agg(F.min_by(F.struct(*keep), F.col(order)).alias("_r")).select(*group, "_r.*")


def stale_hosts(local: DataFrame, web: DataFrame, *, url: str, status: str | None = None) -> DataFrame:
    """Populated local rows whose host no row of the web pass has; none if the web pass is empty, as it then tells nothing."""
    mine = local.withColumn("_h", host(F.col(url))).where(F.col("_h").isNotNull())
    if status:
        mine = mine.where(F.lower(status) == "populated")
    hosts = web.select(host(F.col(url)).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    return mine.join(hosts, "_h", "left_anti").drop("_h") if not web.isEmpty() else mine.limit(0).drop("_h")


def edit_code(find: Column, replace: Column) -> Column:
    """Why an edit proposal cannot be used: missing-keys or find-empty; empty if it can."""
    return F.when(find.isNull() | replace.isNull(), "edit_proposal-missing-keys").when(find == "", "find-empty").otherwise("")


def footer_missing(text: Column, path: str = r"\b(?:evidence|references)/[\w./-]+", footer: str = r"\[source: [^\]]+\]") -> Column:
    """Whether a text names a file and cites none."""
    return F.coalesce(text.rlike(path) & ~text.rlike(footer), F.lit(False))


def metadata_survivors(values: Column, expected: dict[str, str]) -> Column:
    """Names, sorted, of metadata that a scrub left: filled, and not what it should have been set to."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]) if expected else F.create_map().cast("map<string,string>")
    left = F.map_filter(values, lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~F.coalesce(v == F.try_element_at(want, k), F.lit(False)))
    return F.array_join(F.array_sort(F.map_keys(left)), ",")


def history_survivors(blobs: DataFrame, terms: list[str], *, content: str, order: str) -> DataFrame:
    """(blob, first, copies, terms) of different contents in a history that still hold banned terms; each is read once, however often it was committed."""
    from docketry.operators.scrub import survivors

    held = blobs.withColumn("terms", F.array_join(survivors(F.col(content), terms), ",")).where(F.col("terms") != "")
    return held.groupBy(F.sha2(content, 256).alias("blob")).agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.min("terms").alias("terms"))


def commit_gate(changes: DataFrame, *, commit: str, protected: list[str], manifest: str) -> DataFrame:
    """(commit, refused, additions, manifest_missing): only additions are allowed below protected paths, and the manifest must change with them."""
    from docketry.operators.lookups import under

    inside = under(F.col("path"), protected) & (F.col("path") != manifest)
    out = changes.groupBy(commit).agg(
        F.count_if(inside & (F.col("status") != "A")).alias("refused"), F.count_if(inside & (F.col("status") == "A")).alias("additions"), F.count_if(F.col("path") == manifest).alias("_m")
    )
    return out.select(commit, "refused", "additions", ((F.col("additions") > 0) & (F.col("_m") == 0)).alias("manifest_missing"))


def bucketed(rows: DataFrame, *, bucket: str, first: Column, name: Column) -> DataFrame:
    """(bucket, cards, n): names of each bucket in order, those of ``first`` before the others, then by small letters; a report of one row a bucket."""
    card = F.struct((~F.coalesce(first, F.lit(False))).alias("later"), F.lower(name).alias("low"), name.alias("name"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(name.isNotNull(), card))), lambda c: c["name"])
    return rows.groupBy(F.coalesce(filled(F.col(bucket)), F.lit("neutral")).alias(bucket)).agg(F.array_join(listed, " | ").alias("cards"), F.count(name).alias("n"))


def label_gaps(rows: DataFrame, *, group: str, order: list[str], given: str) -> DataFrame:
    """Rows whose label is not the one that its place in the group asks for, with ``expected``."""
    return rank_in_group(rows, [group], order, "_n").withColumn("expected", label(F.col("_n") - 1)).where(~F.col(given).eqNullSafe(F.col("expected"))).drop("_n")


def latest(rows: DataFrame, *, group: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")

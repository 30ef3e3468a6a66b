"""Tagging of correspondence with parties, and the unified timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.values import iso_prefix
from docketry.runtime import checked_join, rank_in_group

#: Letters of a name under which it is looked up.
_HEAD = 4
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def tag_entities(messages: DataFrame, entities: DataFrame, *, key: str, case: str, hay: list[str], entity: str, emails: str, names: str) -> DataFrame:
    """(key, entity): parties of the message's case whose address stands in the texts, or whose name is a part of them.

    Addresses are joined by equality. Names are found by the letters they begin with (up to four, at any
    place of the text) and then checked in full, so a case's messages are never paired with all of its
    parties. Case does not count. Null and empty names and addresses match nothing.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(h, F.lit("")) for h in hay]))
    m = messages.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(case).alias("_c"), text.alias("_t"))
    e = entities.select(F.col(case).alias("_c"), F.col(entity).alias("_e"), F.col(emails).alias("_m"), F.col(names).alias("_n"))
    found = m.select("_k", "_c", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(_EMAIL), F.lit(0)))).alias("_x"))
    mails = e.select("_c", "_e", F.explode("_m").alias("_x")).select("_c", "_e", F.lower("_x").alias("_x"))
    by_mail = found.join(mails, ["_c", "_x"]).select("_k", "_e")
    named = e.select("_c", "_e", F.explode("_n").alias("_n")).where(F.coalesce(F.col("_n"), F.lit("")) != "").select("_c", "_e", F.lower("_n").alias("_n")).distinct()
    named = named.withColumn("_g", F.left("_n", F.lit(_HEAD)))
    sizes = F.array(*[F.lit(i) for i in range(1, _HEAD + 1)])
    starts = lambda s: F.transform(F.sequence(F.lit(1), F.length("_t") - s + 1), lambda i: F.substring(F.col("_t"), i, s))
    grams = F.flatten(F.transform(sizes, lambda s: F.when(F.length("_t") >= s, starts(s)).otherwise(F.array().cast("array<string>"))))
    # texts written alike are searched once; only their digests meet the names, and a text travels again for each name that may stand in it
    digest = F.struct(F.xxhash64("_t"), F.xxhash64(F.lit(1), "_t"))
    texts = m.select("_c", "_t").distinct().withColumn("_h", digest)
    grown = texts.select("_c", "_h", F.explode(F.array_distinct(grams)).alias("_g"))
    heads = checked_join(grown, named, ["_c", "_g"], salt_on=F.col("_h")).select("_c", "_h", "_e", "_n")
    held = texts.join(heads, ["_c", "_h"]).where(F.contains("_t", "_n")).select("_c", "_h", "_e")
    by_name = m.select("_k", "_c", digest.alias("_h")).join(held, ["_c", "_h"]).select("_k", "_e")
    return by_mail.unionByName(by_name).distinct().select(F.col("_k").alias(key), F.col("_e").alias(entity))


# The names of tracks, here and below.
def track(sender_role, recipient_role):
    """Track of a message by the roles of the parties in its From and To headers."""
    sent = F.when(sender_role == "adversary", "inbound").when(sender_role.isin("self", "ally"), "outbound")
    got = F.when(recipient_role == "adversary", "outbound").when(recipient_role.isin("self", "ally"), "inbound")
    return F.coalesce(sent, got, F.lit("correspondence"))


_MARKER = ("marker_date", "kind", "source", "title", "summary", "ref_id", "track")


def union_timeline(events: DataFrame | None = None, messages: DataFrame | None = None, deadlines: DataFrame | None = None) -> DataFrame:
    """Markers of up to three sources, one row each, none dropped as repeated.

    events(date, title, summary, ref_id, track), messages(date, subject, from_addr, to_addr, ref_id, track),
    deadlines(date, label, notes, ref_id, status). Rows whose date does not begin with an ISO day are left out.
    """
    parts = []
    if events is not None:
        parts.append(events.select(iso_prefix(F.col("date")).alias("marker_date"), F.lit("event").alias("kind"), F.lit("events").alias("source"), "title", "summary", F.col("ref_id").cast("string").alias("ref_id"), "track"))
    if messages is not None:
        bits = F.concat_ws(" · ", F.when(F.coalesce(F.trim("from_addr"), F.lit("")) != "", F.concat(F.lit("from: "), F.trim("from_addr"))), F.when(F.coalesce(F.trim("to_addr"), F.lit("")) != "", F.concat(F.lit("to: "), F.trim("to_addr"))))
        title = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit("(no subject)"))
        parts.append(messages.select(iso_prefix(F.col("date")).alias("marker_date"), F.lit("correspondence").alias("kind"), F.lit("correspondence").alias("source"), title.alias("title"), F.nullif(bits, F.lit("")).alias("summary"), F.col("ref_id").cast("string").alias("ref_id"), "track"))
    if deadlines is not None:
        label = F.concat(F.lit("[DEADLINE] "), F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("(unlabeled deadline)")), F.when(F.coalesce("status", F.lit("")).isin("", "populated"), F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("status"), F.lit(")"))))
        parts.append(deadlines.select(iso_prefix(F.col("date")).alias("marker_date"), F.lit("deadline").alias("kind"), F.lit("deadlines").alias("source"), label.alias("title"), F.nullif(F.trim("notes"), F.lit("")).alias("summary"), F.col("ref_id").cast("string").alias("ref_id"), F.lit("deadline").alias("track")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("marker_date").isNotNull()).select(*_MARKER)


def first_party(messages: DataFrame, entities: DataFrame, *, key: str, case: str, header: str, entity: str, order: str, emails: str, names: str) -> DataFrame:
    """(key, entity): of the parties that a header names, the first in the order of the case's list; headers that name none have no row."""
    hits = tag_entities(messages, entities, key=key, case=case, hay=[header], entity=entity, emails=emails, names=names)
    ranks = entities.select(F.col(entity).alias("_e"), F.col(order).alias("_o"))
    return hits.join(ranks, hits[entity] == F.col("_e")).groupBy(key).agg(F.min_by(F.col("_e"), F.col("_o")).alias(entity))


def message_tracks(messages: DataFrame, entities: DataFrame, *, key: str, case: str, sender: str, recipient: str, entity: str, order: str, role: str, emails: str, names: str) -> DataFrame:
    """(key, sender, recipient, track) of every message by the first party in its From and its To header."""
    who = dict(key=key, case=case, entity=entity, order=order, emails=emails, names=names)
    roles = entities.select(F.col(entity).alias("_e"), F.col(role).alias("_r"))
    out = messages.select(key)
    for side, header in (("sender", sender), ("recipient", recipient)):
        one = first_party(messages, entities, header=header, **who)
        one = one.join(roles, one[entity] == F.col("_e")).select(key, F.col(entity).alias(side), F.col("_r").alias(f"_{side}"))
        out = out.join(one, key, "left")
    return out.select(key, "sender", "recipient", track(F.col("_sender"), F.col("_recipient")).alias("track"))


def event_tracks(events: DataFrame, entities: DataFrame, *, key: str, scope: str, ids: str, ident: str, role: str) -> DataFrame:
    """(key, track, parties): the track of an event by the roles of those it names, and who they are as ``id:role`` in order; unknown ones are neutral."""
    asked = events.select(key, F.col(scope).alias("_s"), F.explode_outer(F.array_distinct(ids)).alias("_i"))
    roles = entities.where(F.col(ident).isNotNull()).groupBy(F.col(scope).alias("_s"), F.col(ident).alias("_i")).agg(F.min(role).alias("_r"))
    met = asked.join(roles, ["_s", "_i"], "left")
    party = F.when(F.col("_i").isNotNull(), F.concat("_i", F.lit(":"), F.coalesce("_r", F.lit("neutral"))))
    per = met.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(party)), ",").alias("parties"), F.bool_or(F.col("_r") == "adversary").alias("_a"), F.bool_or(F.col("_r").isin("self", "ally")).alias("_o"))
    kind = F.when(F.col("_a"), "adverse_event").when(F.col("_o"), "self_event").otherwise("neutral_event")
    return per.select(key, kind.alias("track"), "parties")


def timeline_places(markers: DataFrame, *, scope: str, key: str, date: str = "marker_date", out: str = "place") -> DataFrame:
    """Markers with their place from 1 in the order of a timeline: date, kind, title; equal ones by key. A missing date comes first."""
    keyed = markers.withColumn("_d", F.coalesce(date, F.lit("")))
    return rank_in_group(keyed, [scope], ["_d", "kind", "title", key], out).drop("_d")


def message_places(messages: DataFrame, *, scope: str, key: str, date: str, ident: str, out: str = "place") -> DataFrame:
    """Messages with their place from 1 in the order of a correspondence manifest: date, then identifier, both empty where missing; equal ones by key."""
    keyed = messages.withColumns({"_d": F.coalesce(date, F.lit("")), "_i": F.coalesce(ident, F.lit(""))})
    return rank_in_group(keyed, [scope], ["_d", "_i", key], out).drop("_d", "_i")


def entity_markers(markers: DataFrame, ids: str, columns: list[str]) -> DataFrame:
    """(entity_id, columns): every marker under each party it names."""
    return markers.select(F.explode(ids).alias("entity_id"), *columns)

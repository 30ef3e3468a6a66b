"""Queries of the operators on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import lookalikes, mixing, packing, parties, personal, scans, tokens
from docketry.plans.tables import table
from docketry.runtime import materialize


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.line_defects(table(spark, folder, "page_results"), table(spark, folder, "extraction_results"))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired_paragraphs(table(spark, folder, "page_results"), table(spark, folder, "extraction_results"))


def pseudonym_key(spark: SparkSession) -> bytes:
    """Key of the pseudonyms: the session's ``spark.docketry.pseudonymKey``; without it a fixed key, for tests only."""
    return spark.conf.get("spark.docketry.pseudonymKey", "test key of no use elsewhere").encode()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found_items(table(spark, folder, "call_log"), table(spark, folder, "extraction_results"), pseudonym_key(spark)).select("src", "row_id", "start_pos", "kind")


def p4_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    return personal.scrubbed_texts(table(spark, folder, "call_log"), table(spark, folder, "extraction_results"), pseudonym_key(spark))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return parties.party_pairs(table(spark, folder, "entities"), table(spark, folder, "call_log"))


def p6_parties(spark: SparkSession, folder: str) -> DataFrame:
    return parties.party_members(table(spark, folder, "entities"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.document_sizes(table(spark, folder, "documents"))
    return packing.pack(sizes, table(spark, folder, "containers"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder), table(spark, folder, "containers"))


def _mix(spark: SparkSession, folder: str, schedule: DataFrame | None = None) -> DataFrame:
    sizes = materialize(tokens.document_sizes(table(spark, folder, "documents")))
    return mixing.mix(sizes, table(spark, folder, "mix_targets"), schedule=schedule)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used, and at which training positions."""
    return mixing.training_order(_mix(spark, folder), unused=True)


def p8_order(spark: SparkSession, folder: str) -> DataFrame:
    """A curriculum by a schedule table: references fade out, letters come in late, all else is even."""
    knots = [("references", 0.0, 1.0), ("references", 1.0, 0.2), ("letters", 0.0, 0.2), ("letters", 0.5, 0.2), ("letters", 1.0, 1.0)]
    targets = table(spark, folder, "mix_targets")
    schedule = targets.select("mix_id", "source").distinct().join(spark.createDataFrame(knots, "source string, at double, weight double"), "source")
    return mixing.training_order(_mix(spark, folder, schedule))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_mix(spark, folder), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.look_pairs(table(spark, folder, "documents"))


def p9_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.canonical_texts(table(spark, folder, "documents")).select("doc_id", "canonical")


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.look_classes(table(spark, folder, "documents"))


def p4_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with something in it is scrubbed once, whether it holds an item or not."""
    done = p4_scrubbed(spark, folder)
    return done.groupBy("src").agg(F.count("*").alias("texts"), F.count_distinct("row_id").alias("rows_"))


def p6_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity row stands in one party of its own case, whose number is one of its rows."""
    done = materialize(p6_parties(spark, folder))
    heads = done.where(F.col("party_no") == F.col("entity_no")).select("case_id", "party_no", F.lit(True).alias("head"))
    return done.join(heads, ["case_id", "party_no"], "left").groupBy("case_id").agg(F.count("*").alias("rows_"), F.count_distinct("entity_no").alias("entities"), F.count_if(F.col("head").isNull()).alias("headless"))


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """For each kind of container: documents placed, containers over their capacity, documents divided though they fit, documents with pieces missing."""
    kinds = table(spark, folder, "containers")
    placed = materialize(p7_containers(spark, folder))
    over = placed.groupBy("container_kind", "container_no").agg(F.sum("tokens").alias("t")).join(F.broadcast(kinds), "container_kind").groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    docs = placed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("piece_no").alias("last"))
    per = docs.join(F.broadcast(kinds), "container_kind").groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("divided"), F.count_if(F.col("n") != F.col("last")).alias("incomplete"))
    return per.join(over, "container_kind").select("container_kind", "documents", "overfull", "divided", "incomplete")


def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """For each mix: documents in it, uses beyond the cap, positions outside [0, 1], uses without position, and sources off their share by more than their largest document."""
    targets = table(spark, folder, "mix_targets")
    order = materialize(p8_mix(spark, folder))
    caps = F.broadcast(targets.select("mix_id", "source", "max_repeats", "target_share"))
    rows = order.join(caps, ["mix_id", "source"])
    sizes = rows.groupBy("mix_id", "source").agg(F.sum(F.when(F.col("use_no").isNotNull(), F.col("n_tokens"))).alias("t"), F.max("n_tokens").alias("largest"), F.first("target_share").alias("share"))
    whole = sizes.groupBy("mix_id").agg(F.sum("t").alias("all"))
    off = sizes.join(F.broadcast(whole), "mix_id").groupBy("mix_id").agg(F.count_if(F.abs(F.col("t") - F.col("share") * F.col("all")) > F.col("largest")).alias("off"))
    per = rows.groupBy("mix_id").agg(
        F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("use_no") > F.col("max_repeats")).alias("beyond"), F.count_if((F.col("position") < 0) | (F.col("position") > 1)).alias("outside"), F.count_if(F.col("use_no").isNotNull() & F.col("position").isNull()).alias("unplaced")
    )
    return per.join(off, "mix_id")


def p9_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, each once, and their different strings with the most copies of one."""
    classes = p9_classes(spark, folder)
    per = classes.groupBy("variant_id").agg(F.count("*").alias("copies"), F.count_distinct("doc_id").alias("ids"))
    return per.agg(F.sum("copies").alias("documents"), F.sum("ids").alias("ids"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))


QUERIES = {
    "p4_found": p4_found, "p4_scrubbed": p4_scrubbed, "p6_found": p6_found, "p6_parties": p6_parties, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_order": p8_order, "p8_shares": p8_shares,
    "p4_whole": p4_whole, "p6_whole": p6_whole, "p7_whole": p7_whole, "p8_whole": p8_whole, "p9_whole": p9_whole,
    "p9_found": p9_found, "p9_canonical": p9_canonical, "p9_classes": p9_classes,
}

"""Messages delivered at least once: keep exactly one copy of each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.runtime import materialize

#: Bits of a filter word, and bits set for each identifier in its word.
_WORD_BITS, _BITS_SET = 64, 5
_FAR = "9999-12-31 23:59:59"


def message_identifier(raw: Column) -> Column:
    """The identifier as the mail standard calls it: no brackets or white space around it, domain in lower case.

    Null where nothing is left.
    """
    s = F.regexp_replace(raw, r"^[\s <﻿]+|[\s >﻿]+$", "")
    at = F.length(s) - F.locate("@", F.reverse(s)) + 1
    local = F.when(s.contains("@"), F.substring(s, F.lit(1), at)).otherwise(s)
    domain = F.when(s.contains("@"), F.lower(F.substring(s, at + 1, F.length(s)))).otherwise(F.lit(""))
    return F.when(F.length(s) > 0, F.concat(local, domain))


def _mask(ident: Column) -> Column:
    """The bits of an identifier inside its filter word."""
    mask = F.lit(0).cast("bigint")
    for k in range(_BITS_SET):
        bit = F.pmod(F.xxhash64(F.lit(k + 1), ident), F.lit(_WORD_BITS)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def first_copies(df: DataFrame, *, key: str, ident: Column, delivered: str, bucket_days: int = 30) -> DataFrame:
    """One row per identifier: ``ident``, the ``key`` of the copy to keep, and the number of copies.

    1. Storage: one entry per identifier and time bucket, its earliest row and its count, combined on
       the map side, so that an identifier holding a third of all rows shrinks to one row a bucket.
    2. Screen: a Bloom filter per time bucket, laid out in 64-bit words. An entry asks the words of its
       own identifier; where no other bucket's filter answers, it is definitely new and done.
    3. Possible repeats look only into the storage of the buckets whose filter answered and compare
       identifiers exactly, so a false answer of a filter changes nothing.

    Filters are never sent to the driver or broadcast: words and entries are partitioned alike. The
    number of words follows the number of entries (about 12 bits an entry).
    Rows without identifier are left out. A null time counts as later than all others.
    """
    when = F.coalesce(F.col(delivered).cast("timestamp_ntz"), F.lit(_FAR).cast("timestamp_ntz"))
    rows = df.select(F.col(key).alias("_key"), when.alias("_at"), ident.alias("_ident")).where(F.col("_ident").isNotNull())
    rows = rows.withColumn("_bucket", F.floor(F.datediff(F.col("_at").cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days).cast("int"))
    first = F.min(F.struct("_at", "_key")).alias("_first")
    storage = materialize(rows.groupBy("_ident", "_bucket").agg(first, F.count("*").alias("_n")))
    n_words = max(64, (storage.count() * 12) // _WORD_BITS)
    entries = storage.withColumn("_word", F.pmod(F.xxhash64("_ident"), F.lit(n_words))).withColumn("_mask", _mask(F.col("_ident")))
    filters = entries.groupBy("_word", "_bucket").agg(F.bit_or("_mask").alias("_bits"))
    words = filters.groupBy("_word").agg(F.collect_list(F.struct("_bucket", "_bits")).alias("_filters"))
    answers = F.transform(
        F.filter("_filters", lambda f: (f["_bucket"] != F.col("_bucket")) & (f["_bits"].bitwiseAND(F.col("_mask")) == F.col("_mask"))),
        lambda f: f["_bucket"],
    )
    screened = materialize(entries.join(words, "_word").select("_ident", "_bucket", "_first", "_n", answers.alias("_ask")))
    new = screened.where(F.size("_ask") == 0).select("_ident", "_first", "_n")
    ask = screened.where(F.size("_ask") > 0)
    asked = ask.select("_ident", F.col("_first").alias("_mine"), F.col("_n").alias("_own"), F.explode("_ask").alias("_bucket"))
    found = asked.join(storage, ["_ident", "_bucket"], "left").groupBy("_ident", "_mine", "_own")
    found = found.agg(F.min("_first").alias("_other"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_others"))
    kept = found.where(F.col("_other").isNull() | (F.col("_mine") <= F.col("_other"))).select("_ident", F.col("_mine").alias("_first"), (F.col("_own") + F.col("_others")).alias("_n"))
    return new.unionByName(kept).select("_ident", F.col("_first._key").alias("_key"), F.col("_n").alias("_copies"))


def superfluous_copies(df: DataFrame, *, key: str, ident: Column, delivered: str, bucket_days: int = 30) -> DataFrame:
    """All rows but the earliest of each identifier (equal times: the smallest key), with every column of ``df``.

    Rows without identifier are no copies. Only identifiers with several copies reach the join: their rows
    to keep are taken out by key, which is unique, so no task reads all copies of a hot identifier.
    """
    keep = first_copies(df, key=key, ident=ident, delivered=delivered, bucket_days=bucket_days)
    return df.where(ident.isNotNull()).join(keep.select(F.col("_key").alias(key)), key, "left_anti")


def deliver_once(df: DataFrame, *, key: str, ident: Column, delivered: str, bucket_days: int = 30) -> DataFrame:
    """Each message once: the earliest copy of every identifier, and all rows without identifier."""
    keep = first_copies(df, key=key, ident=ident, delivered=delivered, bucket_days=bucket_days).select(F.col("_key").alias(key))
    return df.where(ident.isNotNull()).join(keep, key, "left_semi").unionByName(df.where(ident.isNull()))


class MessageStore:
    """Identifiers delivered so far, kept between batches: folders of entries and of filter words by time bucket.

    ``accept`` takes a batch and gives its rows that were never seen before, one a message. Filters of all
    buckets are read, one 64-bit word for each word number and bucket; entries only of the buckets whose
    filter answers, so old storage is read for possible repeats alone. Entries and words of a batch are
    written under its number, and a batch that is repeated after a failure reads none of its own number
    and writes it again, so nothing is lost and nothing taken twice.
    """

    def __init__(self, spark: SparkSession, path: str, *, bucket_days: int = 30, words: int = 1 << 20):
        self.spark, self.path, self.days, self.words = spark, path.rstrip("/"), bucket_days, words

    def _read(self, part: str, schema: str, batch: int) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}").where(F.col("_batch") != batch)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def accept(self, batch: DataFrame, number: int, *, key: str, ident: Column, delivered: str) -> DataFrame:
        """Rows of the batch to keep: the earliest copy of every identifier not yet in the store, and rows without identifier."""
        at = F.coalesce(F.col(delivered).cast("timestamp_ntz"), F.lit(_FAR).cast("timestamp_ntz"))
        rows = batch.select(F.col(key).alias("_key"), at.alias("_at"), ident.alias("_ident")).where(F.col("_ident").isNotNull())
        firsts = rows.groupBy("_ident").agg(F.min(F.struct("_at", "_key")).alias("_first"))
        bucket = F.floor(F.datediff(F.col("_first._at").cast("date"), F.lit("1970-01-01").cast("date")) / self.days).cast("int")
        mine = firsts.select("_ident", F.col("_first._key").alias("_key"), bucket.alias("_bucket"), F.pmod(F.xxhash64("_ident"), F.lit(self.words)).alias("_word"), _mask(F.col("_ident")).alias("_mask"))
        mine = materialize(mine)
        kind = dict(batch.dtypes)[key]
        filters = self._read("filters", "_word bigint, _bits bigint, _bucket int, _batch bigint", number)
        filters = filters.groupBy("_word", "_bucket").agg(F.bit_or("_bits").alias("_bits"))
        asked = mine.join(filters.withColumnRenamed("_bucket", "_ask"), "_word").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select("_ident", "_ask")
        asked = materialize(asked)
        stored = self._read("entries", f"_ident string, _key {kind}, _bucket int, _batch bigint", number)
        wanted = [r[0] for r in asked.select("_ask").distinct().collect()]  # buckets of a history: one a month
        repeats = stored.where(F.col("_bucket").isin(wanted)).join(asked.withColumnRenamed("_ask", "_bucket"), ["_ident", "_bucket"], "left_semi").select("_ident").distinct()
        new = materialize(mine.join(repeats, "_ident", "left_anti"))
        stamped = new.withColumn("_batch", F.lit(number).cast("bigint"))
        out = lambda df, part: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_bucket").parquet(f"{self.path}/{part}")
        out(stamped.select("_ident", "_key", "_bucket", "_batch"), "entries")
        out(stamped.groupBy("_word", "_bucket", "_batch").agg(F.bit_or("_mask").alias("_bits")), "filters")
        return batch.where(ident.isNotNull()).join(new.select(F.col("_key").alias(key)), key, "left_semi").unionByName(batch.where(ident.isNull()))

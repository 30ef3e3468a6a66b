"""Pages of documents from several extractors: merging, reconciling, putting together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.quality import quality, token_f1
from docketry.functions.text import strip


def merge_pages(base: DataFrame, other: DataFrame, *, keys: list[str], text: str = "text", garbled: str = "garbled") -> DataFrame:
    """Pages of ``base``; a garbled one takes the other side's text where that is neither garbled nor blank.

    Only the keys of garbled pages reach into ``other`` (semi join), so each tier reads as many pages as
    the one before it failed on. ``merged`` tells which pages changed. The other side's keys are unique.
    """
    wanted = other.join(base.where(F.col(garbled)).select(*keys), keys, "left_semi").select(*keys, F.col(text).alias("_t"), F.col(garbled).alias("_g"))
    take = F.coalesce(F.col(garbled), F.lit(False)) & ~F.coalesce(F.col("_g"), F.lit(True)) & (strip(F.coalesce("_t", F.lit(""))) != "")
    joined = base.join(wanted, keys, "left").withColumn("merged", take)
    return joined.withColumn(text, F.when(take, F.col("_t")).otherwise(F.col(text))).withColumn(garbled, F.col(garbled) & ~take).drop("_t", "_g")


def reconcile_pages(primary: DataFrame, shadow: DataFrame, *, keys: list[str], text: str = "text", floor: float = 0.85) -> DataFrame:
    """Primary pages with agreement (token F1), disagrees and chosen: where two readings disagree, the more readable wins; ties keep the primary."""
    s = shadow.select(*keys, F.col(text).alias("_s"), F.lit(True).alias("_has"))
    j = primary.join(s, keys, "left")
    a, b = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col("_s"), F.lit(""))
    j = j.withColumn("agreement", F.when(F.col("_has"), token_f1(a, b)))
    off = F.coalesce(F.col("agreement") < floor, F.lit(False))
    better = off & (quality(b) > quality(a))
    return j.withColumn("disagrees", off).withColumn("chosen", F.when(better, "shadow").otherwise("primary")).withColumn(text, F.when(better, b).otherwise(F.col(text))).drop("_s", "_has")


def document_text(pages: DataFrame, *, doc: str, number: str, text: str = "text") -> DataFrame:
    """(doc, text, n_pages): stripped pages that are not blank, in order, a blank line between them.

    A document's pages are gathered into one string, which is the result's own size.
    """
    row = F.struct(F.col(number).alias("n"), strip(F.coalesce(text, F.lit(""))).alias("t"))
    kept = F.filter(F.array_sort(F.collect_list(row)), lambda x: x.t != "")
    return pages.groupBy(doc).agg(F.array_join(F.transform(kept, lambda x: x.t), "\n\n").alias("text"), F.count("*").alias("n_pages"))


def escalate(tiers: list[DataFrame], *, keys: list[str], force: int | None = None) -> DataFrame:
    """Pages through a cascade of extractors, cheapest first: each tier supplies only what is still garbled. ``force`` takes all pages from one tier."""
    if force is not None:
        return tiers[force].withColumn("tier", F.lit(force))
    out = tiers[0].withColumn("tier", F.lit(0))
    for k, t in enumerate(tiers[1:], 1):
        out = merge_pages(out, t, keys=keys).withColumn("tier", F.when(F.col("merged"), F.lit(k)).otherwise(F.col("tier"))).drop("merged")
    return out


def html_cascade(docs: DataFrame, *, tiers: list[str], raw_length: str, key: str, force: int | None = None) -> DataFrame:
    """(key, text, tier): the text of the first tier that is neither garbled nor, from the second on, too short for its source.

    A later tier counts only where it has more text than what stands before it; if none will do, the
    longest is kept. ``tiers`` are columns with what each extractor read, null where it failed.
    ``force`` ends at one tier, which still has to beat an empty text.
    """
    from docketry.functions.quality import html_is_empty, with_garble

    last = len(tiers) - 1 if force is None else force
    out = docs.withColumn("_text", F.lit("")).withColumn("_tier", F.lit(0)).withColumn("_done", F.lit(False))
    for k in range(last + 1) if force is None else [force]:
        longer = ~F.col("_done") & (F.length(F.coalesce(tiers[k], F.lit(""))) > F.length("_text"))
        out = out.withColumn("_take", longer).withColumn("_text", F.when(F.col("_take"), F.col(tiers[k])).otherwise(F.col("_text"))).withColumn("_tier", F.when(F.col("_take"), F.lit(k)).otherwise(F.col("_tier")))
        scored = with_garble(out, "_text", page=False, prefix="_s_")
        empty = html_is_empty(F.length("_text"), F.col(raw_length)) if k else F.lit(False)
        out = scored.withColumn("_done", F.col("_done") | ~F.col("_s_garbled") & ~empty).drop(*[c for c in scored.columns if c.startswith("_s_")])
    return out.select(key, F.col("_text").alias("text"), F.col("_tier").alias("tier"))

"""Reference documents: ingest, consent, listing, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.quality import with_assessment
from docketry.functions.text import filled, host
from docketry.operators.documents import reference_slug, reference_text
from docketry.operators.integrity import one_per_key
from docketry.operators.lookups import unique_slugs


def ingest(docs: DataFrame, existing: DataFrame, *, order: str, kind: Column, content: str = "content") -> DataFrame:
    """New reference documents as manifest rows: source_id, slug, content type, text, title, flags, appears_complete.

    ``docs``: (path, content, content_type, citation, url, ``order``). Equal contents are one document, the
    first in ``order``; those whose source_id is in ``existing`` are left out. Slugs are numbered from their
    second use on. Rows without content have no hash and fall out.
    """
    hashed = docs.where(F.col(content).isNotNull()).withColumn("sha256", F.sha2(content, 256))
    new = one_per_key(hashed, "sha256", order).withColumn("source_id", F.left("sha256", F.lit(16)))
    new = new.join(existing.select("source_id"), "source_id", "left_anti")
    new = new.withColumn("slug", reference_slug(F.col("citation"), F.col("url"), F.col("path")))
    new = unique_slugs(new, "slug", [order]).drop("slug").withColumnRenamed("unique_slug", "slug")
    declared = new.withColumn("_kind", kind)
    read = reference_text(declared, content=content).withColumnRenamed("kind", "content_kind")
    return with_assessment(read, "text", F.col("_kind")).drop("_kind")


def consented(rows: DataFrame, consents: DataFrame, *, provider: str, local: list[str]) -> DataFrame:
    """Rows whose provider is local, or has a row in ``consents`` that grants it; one without a row is refused."""
    granted = consents.where(F.coalesce("granted", F.lit(False))).select(F.col("provider").alias(provider)).distinct()
    return rows.where(F.col(provider).isin(*local)).unionByName(rows.where(~F.col(provider).isin(*local)).join(granted, provider, "left_semi"))


def listing(rows: DataFrame, *, columns: dict[str, int], kind: str | None = None, order: str) -> DataFrame:
    """A listing: place in the order given, and each column cut to its width with a mark where something is cut; ``kind`` keeps one kind."""
    from docketry.runtime import rank_in_group

    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(F.coalesce(c, F.lit("")))
    kept = rows if kind is None else rows.where(F.col("kind") == kind)
    placed = rank_in_group(kept.withColumn("_one", F.lit(1)), ["_one"], [order], "place").drop("_one")
    return placed.select("place", order, *[cut(F.col(c), n).alias(c) for c, n in columns.items() if c != order])


def cards(regulators: DataFrame, authorities: DataFrame, *, name: str, detail: str) -> DataFrame:
    """(source, name, detail) of those who may decide, from both tables; blank names are dropped, repeated ones are not."""
    part = lambda df, source: df.where(filled(F.trim(name)).isNotNull()).select(F.lit(source).alias("source"), F.trim(name).alias("name"), F.coalesce(detail, F.lit("")).alias("detail"))
    return part(regulators, "party").unionByName(part(authorities, "reference"))


def fetched(rows: DataFrame, *, url: str, content: str) -> DataFrame:
    """Add host, size_bytes and sha256 of what was fetched from an address."""
    return rows.withColumns({"host": host(F.col(url)), "size_bytes": F.octet_length(content), "sha256": F.sha2(content, 256)})

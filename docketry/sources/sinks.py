"""Writing manifests, layers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_shasum(manifest: DataFrame, path: str) -> None:
    """``<hex>  <path>`` lines in the order of paths; range-sorted, so the part files in order are the manifest."""
    lines = manifest.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value"))
    lines.write.mode("overwrite").text(path)


def write_layers(raw: DataFrame, structured: DataFrame, human: DataFrame, path: str) -> None:
    """Three layers of an ingest, each partitioned by source_id. Keys are checked before this, so a refused ingest leaves nothing behind."""
    for name, df in (("raw", raw), ("structured", structured), ("human", human)):
        df.write.mode("append").partitionBy("source_id").parquet(f"{path}/{name}")


def write_report(changes: DataFrame, path: str) -> None:
    """Scrub report as JSON lines; originals stand only as digests."""
    changes.select(*[c for c in changes.columns if c != "original"]).write.mode("overwrite").json(path)

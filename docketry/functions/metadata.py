"""File metadata left by browsers and operating systems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import filled


def quarantine(value: Column) -> Column:
    """``flags;hex time;application;id`` as a struct; null for another shape."""
    p = F.split(value, ";")
    sec = F.conv(F.get(p, F.lit(1)), 16, 10).try_cast("bigint")
    part = lambda i: filled(F.get(p, F.lit(i)))
    return F.when(F.size(p) >= 3, F.struct(part(0).alias("flags"), F.timestamp_seconds(sec).alias("downloaded_at"), part(2).alias("application"), part(3).alias("event_id")))


def zone_identifier(text: Column) -> Column:
    """Key and value lines of a ``[ZoneTransfer]`` block as a struct with the zone's name."""
    # Zone number -> name.
    names = {"0": "local machine", "1": "local intranet", "2": "trusted sites", "3": "internet", "4": "restricted sites"}
    get = lambda k: filled(F.trim(F.regexp_extract(text, rf"(?im)^\s*{k}\s*=\s*(.*)$", 1)))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), get("ZoneId"))
    return F.when(F.contains(text, F.lit("ZoneTransfer")), F.struct(get("ZoneId").alias("zone_id"), label.alias("zone"), get("ReferrerUrl").alias("referrer_url"), get("HostUrl").alias("host_url")))


def _origins(values: pd.Series) -> pd.Series:
    import plistlib

    def one(v):
        if not v:
            return None
        raw = v[4:] if v.startswith("hex:") else v
        try:
            data = plistlib.loads(bytes.fromhex(raw.replace(" ", "").replace("\n", "")))
        except Exception:  # noqa: BLE001 - any broken list counts as plain text
            return [v] if "://" in v else None
        return [str(x) for x in (data if isinstance(data, list) else [data]) if x]

    return values.map(one)


def where_from(value: Column) -> Column:
    """Download addresses: a plain address, or a binary property list in hexadecimal."""
    return F.pandas_udf(_origins, "array<string>")(value)


def origins(*lists: Column) -> Column:
    """All addresses in order, each once; null lists count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))

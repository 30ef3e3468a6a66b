"""Time stamps as many writers print them, read to one UTC instant.

The readers are Column expressions only: one pattern per family of formats rewrites a stamp into
``year|month|day|hour|minute|second|half|zone``, and the parts are checked and added up from there.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years of the instants that are read unless a caller names others; they set the size of the interval table.
YEARS = (1970, 2037)
#: Width of the key under which zone intervals are found, in seconds (about 194 days).
_BUCKET = 1 << 24

# Zone letters of the USA and of universal time, with their offsets in minutes.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DOW = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r" ?(z|[a-z]{2,4}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+-]+)+)?(?: ?\(.*\))?( ?\[[a-z0-9/_+-]+\])?"

#: (cheap test, pattern, replacement) per family; the target is y|m|d|h|mi|s|half|zone|bracketed zone.
_FAMILIES = (
    (lambda s: F.instr(s, "/").between(2, 3), rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? +{_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (lambda s: F.instr(s, ".").between(2, 3), rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? +{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (lambda s: F.substring(s, 5, 1).isin("-", "/", "."), rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:t|,? +){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (lambda s: F.substring(s, 9, 1).isin("t", " "), rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t| +)(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7|$8"),
    (lambda s: s.rlike(r"^[a-z].* \d{4}$"), rf"^{_DOW}{_MON} +(\d{{1,2}}) +(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?: +([a-z]{{3,4}}))? +(\d{{4}})$", "$7|$1|$2|$3|$4|$5||$6|"),
    (lambda s: s.rlike(r"^(?:[a-z]+\.?,? +)?\d\d?[ -][a-z]"), rf"^{_DOW}(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}|\d{{2}}),? +{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (lambda s: s >= "a", rf"^{_DOW}{_MON} +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}),?(?: at)? +{_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)


def clean_stamp(raw: Column) -> Column:
    """White space of any kind to single blanks, none at the ends; lower case; no bar."""
    return F.lower(F.trim(F.regexp_replace(raw, r"[\s   ﻿‎|]+", " ")))


def epoch_number(stamp: Column) -> Column:
    """The whole part of a count since 1970, or null."""
    return F.when(stamp.rlike(r"^\d{9,19}(?:\.\d*)?$"), F.substring_index(stamp, ".", 1).try_cast("long"))


def bounds(years: tuple[int, int]) -> tuple[int, int]:
    """First second of the first year and end of the last, in UTC."""
    return tuple(int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (years[0], years[1] + 1))


def epoch_seconds(whole: Column, years: tuple[int, int]) -> Column:
    """Instants given as a count since 1970, in whichever unit puts them into the years allowed."""
    low, high = bounds(years)
    tries = [F.call_function("div", whole, F.lit(k)) if k > 1 else whole for k in (1, 1_000, 1_000_000, 1_000_000_000)]
    return F.coalesce(*[F.when((t >= low) & (t < high), t.cast("long")) for t in tries])


def _micros(stamp: Column, whole: Column, seconds: Column) -> Column:
    """Microseconds behind the full second: of a count since 1970, or the digits behind the clock's seconds."""
    sub = lambda text: F.rpad(F.left(text, F.lit(6)), 6, "0").try_cast("int")
    unit = lambda k: F.when((whole >= seconds * k) & (whole < (seconds + 1) * k), (whole - seconds * k) * F.lit(1_000_000) / F.lit(k)).cast("int")
    decimal = F.when(whole == seconds, sub(F.regexp_extract(stamp, r"^\d+\.(\d+)$", 1)))
    counted = F.coalesce(decimal, *[unit(k) for k in (1_000, 1_000_000, 1_000_000_000)], F.lit(0))
    clock = F.coalesce(sub(F.regexp_extract(stamp, r"(?::\d{2}:\d{2}|[t ]\d{6})[.,](\d+)", 1)), F.lit(0))
    return F.when(whole.isNotNull(), counted).otherwise(clock)


def with_stamp(df: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """Of (_row, _raw, _given): _row, and the stamp itself, its wall clock, offset, zone and count since 1970."""
    s = F.col("_stamp")
    for test, pattern, parts in _FAMILIES:
        canon = F.when(test(s), F.regexp_replace(s, pattern, parts)) if test is _FAMILIES[0][0] else canon.when(test(s), F.regexp_replace(s, pattern, parts))
    df = df.select("_row", "_given", clean_stamp(F.col("_raw")).alias("_stamp")).withColumn("_canon", canon)
    df = df.withColumn("_p", F.when(F.contains("_canon", F.lit("|")), F.split("_canon", r"\|", -1)))
    p = lambda i: F.get("_p", F.lit(i))
    num = lambda i: p(i).try_cast("int")
    year = F.when(F.length(p(0)) == 2, num(0) + 2000).otherwise(num(0))
    month_no = (F.instr(F.lit(_MONTHS), F.substring(p(1), 1, 3)) + 2) / 3
    month = F.coalesce(num(1), month_no.cast("int"))
    df = df.select(
        "_row", "_given", "_stamp", epoch_number(s).alias("_whole"), year.alias("_y"), month.alias("_m"), num(2).alias("_d"), num(3).alias("_h24"), num(4).alias("_mi"),
        F.coalesce(num(5), F.lit(0)).alias("_s"), p(6).alias("_half"), p(7).alias("_z"), F.regexp_replace(F.when(p(7).rlike(r"[+-]\d"), p(7)), "[a-z:]", "").alias("_sd"), F.regexp_replace(p(8), r"[\[\] ]", "").alias("_br"),
    )
    twelve = F.col("_half").isin("a", "p")
    df = df.withColumn("_hour", F.when(twelve, F.when(F.col("_h24").between(1, 12), F.col("_h24") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))).otherwise(F.col("_h24")))
    hour = F.col("_hour")
    real = F.col("_y").between(years[0] - 1, years[1] + 2) & F.col("_m").between(1, 12) & F.col("_d").between(1, 31) & hour.between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    first = F.when(real, F.make_date("_y", "_m", F.lit(1)))
    day = F.when(F.col("_d") <= F.dayofmonth(F.last_day(first)), F.date_add(first, F.col("_d") - 1))
    local = F.unix_date(day).cast("long") * 86400 + hour * 3600 + F.col("_mi") * 60 + F.col("_s")
    z, sign = F.col("_z"), F.substring("_sd", 1, 1)
    digits = F.when(F.length("_sd") % 2 == 0, F.concat(F.lit("0"), F.substring("_sd", 2, 6))).otherwise(F.substring("_sd", 2, 6))
    part = lambda a: F.coalesce(F.substring(digits, a, 2).try_cast("int"), F.lit(0))
    numeric = F.when(sign == "-", -1).otherwise(1) * (part(1) * 3600 + part(3) * 60 + part(5))
    numeric = F.when((part(1) <= 18) & (part(3) <= 59), numeric)
    letters = F.create_map(*[F.lit(x) for k, v in ZONE_LETTERS.items() for x in (k.lower(), v * 60)])
    named = F.when(z.contains("/"), z).otherwise(F.when(F.col("_br").contains("/") | F.col("_br").isin("utc", "gmt"), F.col("_br")))
    given = F.coalesce(F.when(F.trim("_given") != "", F.lower(F.trim("_given"))), F.lit("utc"))
    silent = F.coalesce(z, F.lit("")) == ""
    offset = F.when(F.col("_sd").isNotNull(), numeric).otherwise(F.try_element_at(letters, z))
    return df.select(
        "_row", "_stamp", "_whole",
        local.alias("_local"),
        F.when(~z.contains("/"), offset).cast("long").alias("_offset"),
        F.when(local.isNotNull() & (silent | z.contains("/")), F.coalesce(named, F.when(silent, given))).alias("_zone"),
        epoch_seconds(F.col("_whole"), years).alias("_epoch"),
    )


@lru_cache(maxsize=4)
def zone_intervals(years: tuple[int, int] = YEARS) -> list[tuple[str, int, int, int]]:
    """(zone, offset, first local second, end of local seconds) of every zone of the time-zone database.

    Local seconds are read off the wall clock. The table's size is set by the database and the years
    allowed, not by the data: about 2,500 rows a year.
    """
    from zoneinfo import ZoneInfo, available_timezones

    first, end = bounds(years)
    step, low, high = 14 * 86400, first - 3 * 86400, end + 3 * 86400
    out = []
    for name in sorted(available_timezones()):
        if name.startswith(("posix/", "right/")) or name in ("localtime", "Factory"):
            continue
        z = ZoneInfo(name)
        at = lambda t: int(datetime.fromtimestamp(t, z).utcoffset().total_seconds())  # noqa: B023, E731
        start, now, t = low, at(low), low
        while t < high:
            nxt = min(t + step, high)
            if (new := at(nxt)) != now:
                a, b = t, nxt
                while b - a > 1:
                    m = (a + b) // 2
                    a, b = (m, b) if at(m) == now else (a, m)
                out.append((name.lower(), now, start + now, b + now))
                start, now = b, at(b)
                nxt = b if now != new else nxt
            t = nxt
        out.append((name.lower(), now, start + now, high + now))
    return out


@lru_cache(maxsize=4)
def _interval_arrow(years: tuple[int, int]):
    import pyarrow as pa

    rows: dict[tuple[str, int], list] = {}
    for zone, offset, a, b in zone_intervals(years):
        for k in range(a // _BUCKET, (b - 1) // _BUCKET + 1):
            rows.setdefault((zone, k), []).append({"a": a, "b": b, "o": offset})
    interval = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("o", pa.int64())]))
    keys = list(rows)
    return pa.table({"_zone": [z for z, _ in keys], "_bucket": pa.array([k for _, k in keys], pa.int64()), "_iv": pa.array(list(rows.values()), interval)})


def interval_table(spark: SparkSession, years: tuple[int, int] = YEARS) -> DataFrame:
    """Zone-offset intervals exploded to the buckets they touch: (zone, bucket, intervals)."""
    return spark.createDataFrame(_interval_arrow(years))


def normalize_timestamps(
    df: DataFrame, raw: str, *, zone: Column | None = None, out: str = "utc_s", status: str | None = None, micros: str | None = None, years: tuple[int, int] = YEARS
) -> DataFrame:
    """Add ``out``, the UTC instant in whole seconds that the stamp in ``raw`` means, or null.

    Stamps with an offset, zone letters or a count since 1970 tell their instant. All others are wall
    clocks of a named zone (in the stamp, else ``zone``, else UTC): an as-of join finds the zone-offset
    intervals that hold the wall clock. One interval gives the offset; two mean that the zone has this
    time twice, none that it skips it, and both give null. The interval side is bounded by the time-zone
    database and ``years`` and broadcast, so no row of ``df`` is shuffled.

    ``years``: first and last year of the instants to read; counts since 1970 are taken in the unit that
    falls into them, and a stamp outside is unreadable. ``micros``, if named, is the instant in
    microseconds, with the digits behind the second that the stamp has (the first six of them).

    Null, empty, unreadable stamps and impossible dates give null, as do unknown zones and letters.
    Rows are neither lost nor repeated, and all columns of ``df`` stay; ``status``, if named, tells
    ``instant``, ``ambiguous``, ``nonexistent`` or ``unreadable``.
    """
    low, high = bounds(years)
    given = zone if zone is not None else F.lit(None).cast("string")
    packed = df.select(F.struct("*").alias("_row"), F.col(raw).alias("_raw"), given.alias("_given"))
    work = with_stamp(packed, years).withColumn("_bucket", F.floor(F.col("_local") / _BUCKET).cast("long"))
    table = interval_table(df.sparkSession, years)
    joined = work.join(F.broadcast(table), ["_zone", "_bucket"], "left")
    hit = F.filter("_iv", lambda i: (F.col("_local") >= i.a) & (F.col("_local") < i.b))
    joined = joined.withColumn("_hit", F.when(F.col("_offset").isNull() & F.col("_zone").isNotNull(), hit))
    n = F.size("_hit")
    utc = F.coalesce(F.col("_epoch"), F.col("_local") - F.col("_offset"), F.when(n == 1, F.col("_local") - F.get("_hit", F.lit(0)).o))
    utc = F.when((utc >= low) & (utc < high), utc)
    cols = [*[F.col("_row")[c].alias(c) for c in df.columns if c not in (out, status, micros)], utc.cast("long").alias(out)]
    if micros:
        cols.append((utc * 1_000_000 + _micros(F.col("_stamp"), F.col("_whole"), utc)).cast("long").alias(micros))
    if status:
        cols.append(F.when(utc.isNotNull(), "instant").when(n == 2, "ambiguous").when((n == 0) & F.col("_iv").isNotNull(), "nonexistent").otherwise("unreadable").alias(status))
    return joined.select(*cols)

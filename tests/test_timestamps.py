from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions.timestamps import normalize_timestamps

NY = "America/New_York"
CASES = [
    ("2024-02-07T08:12:40Z", None, "2024-02-07 08:12:40"), ("2024-02-07T08:12:40+02:00", NY, "2024-02-07 06:12:40"), ("2024-02-07 08:12:40-0530", NY, "2024-02-07 13:42:40"),
    ("2024-07-07 08:12:40", NY, "2024-07-07 12:12:40"), ("2024-01-07 08:12:40", None, "2024-01-07 08:12:40"), ("2024-01-07 08:12:40", " ", "2024-01-07 08:12:40"),
    ("11/05/2024 1:26:01 AM", "America/Denver", "2024-11-05 08:26:01"), ("4/17/23 9:00 PM", None, "2023-04-17 21:00:00"), ("03.06.2022 15:50", "Europe/London", "2022-06-03 14:50:00"),
    ("Feb 18, 2025 12:07:48 AM EST", None, "2025-02-18 05:07:48"), ("Mon, 22 Jan 2024 16:57:11 -0800", None, "2024-01-23 00:57:11"), ("Jul  1 02:32:49 2023", None, "2023-07-01 02:32:49"),
    ("20241127T234825Z", NY, "2024-11-27 23:48:25"), ("1636537270457", NY, "2021-11-10 09:41:10"), ("1636537270", NY, "2021-11-10 09:41:10"), ("1690128465687218", None, "2023-07-23 16:07:45"),
    ("1695664042.999", None, "2023-09-25 17:47:22"), ("2024-05-02 05:07:01 America/New_York", None, "2024-05-02 09:07:01"), ("2024-05-12T20:01:12-07:00[America/Los_Angeles]", NY, "2024-05-13 03:01:12"),
    ("\t2024-02-07T08:12:40Z ", None, "2024-02-07 08:12:40"), ("2023-11-05 01:30:00 EDT", NY, "2023-11-05 05:30:00"),
    ("2023-11-05 01:30:00", NY, None), ("2024-03-10 02:30:00", NY, None), ("2023-02-30T10:15:00Z", None, None), ("2024-13-05 08:00", None, None), ("0000-00-00 00:00:00", None, None),
    ("13:15 yesterday", None, None), ("", None, None), (None, NY, None), ("12/05/2024 13:00:00 PM", None, None), ("2024-01-07 08:12:40", "Mars/Base", None), ("2024-01-07 08:12:40 XYZ", None, None), ("x" * 100_000, None, None),
]


def seconds(s):
    return None if s is None else int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp())


def test_formats_zones_and_clash_of_names(spark):
    rows = [(i, raw, zone, i) for i, (raw, zone, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, raw string, zone string, _local int")
    got = normalize_timestamps(df, "raw", zone=F.col("zone"), status="status")
    assert got.columns == ["id", "raw", "zone", "_local", "utc_s", "status"]
    found = {r.id: (r.utc_s, r.status) for r in got.collect()}
    for i, (raw, _, want) in enumerate(CASES):
        assert found[i][0] == seconds(want), (raw, found[i])
    status = {CASES[i][0]: s for i, (_, s) in found.items()}
    assert status["2023-11-05 01:30:00"] == "ambiguous" and status["2024-03-10 02:30:00"] == "nonexistent"


def test_empty_table(spark):
    assert normalize_timestamps(spark.createDataFrame([], "raw string"), "raw").count() == 0


def test_wall_clocks_against_the_zone_database(spark):
    zones = [NY, "Europe/London", "America/Phoenix", "Australia/Lord_Howe", "Asia/Kathmandu"]
    start, rows = datetime(2021, 1, 1), []
    for k in range(1500):
        rows.append(((start + timedelta(hours=11 * k, minutes=17 * k % 60)).strftime("%Y-%m-%d %H:%M:%S"), zones[k % 5]))
    for z, d in ((NY, "2022-03-13"), (NY, "2022-11-06"), ("Europe/London", "2023-10-29"), ("Australia/Lord_Howe", "2023-04-02")):
        rows += [(f"{d} {h:02}:{m:02}:00", z) for h in range(4) for m in (0, 15, 30, 45)]
    got = normalize_timestamps(spark.createDataFrame(rows, "raw string, zone string"), "raw", zone=F.col("zone")).collect()
    for r in got:
        local, z = datetime.fromisoformat(r.raw), ZoneInfo(r.zone)
        means = {t for f in (0, 1) if (t := local.replace(tzinfo=z, fold=f).astimezone(timezone.utc)).astimezone(z).replace(tzinfo=None) == local}
        assert r.utc_s == (int(means.pop().timestamp()) if len(means) == 1 else None), r


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1_430_000_000, 1_900_000_000), min_size=1, max_size=20))
def test_every_printing_of_an_instant_reads_alike(spark, instants):
    rows = []
    for t in instants:
        d = datetime.fromtimestamp(t, timezone.utc)
        e = d.astimezone(timezone(timedelta(hours=-7)))
        rows += [(t, x) for x in (d.strftime("%Y-%m-%dT%H:%M:%SZ"), str(t), str(t * 1000), d.strftime("%m/%d/%Y %I:%M:%S %p"), d.strftime("%b %d, %Y %I:%M:%S %p GMT"), e.strftime("%a, %d %b %Y %H:%M:%S %z"), e.isoformat(), d.strftime("%Y%m%dT%H%M%SZ"))]
    got = normalize_timestamps(spark.createDataFrame(rows, "t bigint, raw string"), "raw").where("utc_s is null or utc_s <> t")
    assert got.count() == 0


def test_years_are_a_parameter_and_fractions_are_kept(spark):
    rows = [("2014-06-01T10:00:00.25Z",), ("2031-06-01T10:00:00Z",), ("1973-11-29T21:33:09Z",), ("1400000000123",), ("1400000000.5",), ("2036-07-01 12:00:00,123456 America/New_York",), ("20240102T030405.7Z",)]
    df = spark.createDataFrame(rows, "raw string")
    got = {r.raw: (r.utc_s, r.us) for r in normalize_timestamps(df, "raw", micros="us").collect()}
    assert got["2014-06-01T10:00:00.25Z"] == (1401616800, 1401616800250000) and got["2031-06-01T10:00:00Z"][0] == 1938074400
    assert got["1400000000123"] == (1400000000, 1400000000123000) and got["1400000000.5"] == (1400000000, 1400000000500000)
    assert got["1973-11-29T21:33:09Z"][0] == 123456789 and got["20240102T030405.7Z"][1] % 1_000_000 == 700_000
    assert got["2036-07-01 12:00:00,123456 America/New_York"][1] % 1_000_000 == 123456
    few = {r.raw: r.utc_s for r in normalize_timestamps(df, "raw", years=(2015, 2030)).collect()}
    assert [k for k, v in few.items() if v is not None] == ["20240102T030405.7Z"]

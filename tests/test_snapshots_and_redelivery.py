import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docketry.operators.redelivery import deliver_once, first_copies, message_identifier, superfluous_copies
from docketry.operators.snapshots import evidence_changes, hex_number
from docketry.runtime import checked_join, prefix_sums

T0 = datetime(2024, 1, 1)
ENTRY = "entry_id bigint, case_id string, snapshot_no int, path string, mtime string, sha256 string, loaded_at timestamp_ntz, pair int, later boolean"


def entries(spark, rows):
    return spark.createDataFrame([(i, c, n, p, m, s, T0 + timedelta(seconds=k), 1, True) for i, (c, n, p, m, s, k) in enumerate(rows)], ENTRY)


def test_kinds_of_change(spark):
    a, b = "AB" * 32, "cd" * 32
    rows = [
        ("x", 1, "same", "2024-01-01T00:00:00Z", a, 0), ("x", 4, "same", "1704067200", a.lower(), 0), ("x", 1, "gone", None, a, 0), ("x", 4, "new", None, a, 0),
        ("x", 1, "sha", None, a, 0), ("x", 4, "sha", None, b, 0), ("x", 1, "time", "2024-01-01T00:00:00Z", None, 0), ("x", 4, "time", "2024-01-01T00:00:01Z", b, 0),
        ("x", 1, "unknown", "?", None, 0), ("x", 4, "unknown", "2024-01-01T00:00:01Z", b, 0), ("x", 1, "late", None, a, 9), ("x", 1, "late", None, b, 1), ("x", 4, "late", None, a, 0),
        ("y", 2, "only", None, a, 0), (None, 1, "p", None, a, 0), ("x", 1, None, None, a, 0), ("x", 4, None, None, b, 0),
    ]
    got = {(r.case_id, r.snapshot_no, r.path, r.change_kind) for r in evidence_changes(entries(spark, rows)).collect()}
    assert got == {("x", 4, "gone", "removed"), ("x", 4, "new", "added"), ("x", 4, "sha", "changed"), ("x", 4, "time", "changed"), ("x", 4, None, "changed")}
    assert evidence_changes(entries(spark, [])).count() == 0


def test_hex_numbers(spark):
    df = spark.createDataFrame([("0xAB",), (" ab ",), ("00ab",), ("xyz",), ("",), (None,)], "v string").select(hex_number(F.col("v")).alias("h"))
    assert [r.h for r in df.collect()] == ["ab".rjust(64, "0")] * 3 + [None] * 3


def test_identifiers(spark):
    rows = [("<a@B.C>",), (" \r\n <a@b.c> ",), ("A@b.c",), ("<>",), ("",), (None,), ("plain",), ("x@y@Z",)]
    got = [r.i for r in spark.createDataFrame(rows, "m string").select(message_identifier(F.col("m")).alias("i")).collect()]
    assert got == ["a@b.c", "a@b.c", "A@b.c", None, None, None, "plain", "x@y@z"]


def test_copies_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, "", "<hot@x>", f"<m{rng.randrange(150)}@X>", f"m{rng.randrange(150)}@x"]), T0 + timedelta(days=rng.randrange(900)) if rng.random() > 0.05 else None, 7) for k in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, message_id string, at timestamp_ntz, _key int")
    ident = message_identifier(F.col("message_id"))
    norm = lambda m: (m or "").strip("<>").lower() or None
    best = {}
    for k, m, at, _ in rows:
        if (i := norm(m)) is not None:
            best[i] = min(best.get(i, (datetime.max, 1 << 60)), (at or datetime.max, k))
    keep = {k for _, k in best.values()}
    extra = superfluous_copies(df, key="id", ident=ident, delivered="at", bucket_days=20)
    assert extra.columns == df.columns
    assert {r.id for r in extra.collect()} == {k for k, m, *_ in rows if norm(m) is not None and k not in keep}
    assert {r.id for r in deliver_once(df, key="id", ident=ident, delivered="at").collect()} == keep | {k for k, m, *_ in rows if norm(m) is None}
    counts = {r._ident: r._copies for r in first_copies(df, key="id", ident=ident, delivered="at").collect()}
    assert counts["hot@x"] == sum(norm(m) == "hot@x" for _, m, *_ in rows)
    assert superfluous_copies(df.limit(0), key="id", ident=ident, delivered="at").count() == 0


def test_prefix_sums_and_checked_join(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 5).alias("v"))
    out = prefix_sums(df, ["g"], ["id"], "v", "at", buckets=16).where("g = 'hot'").orderBy("at", "v").collect()
    run = 0
    for r in sorted(out, key=lambda r: (r["at"], r["v"] > 0)):
        assert r["at"] == run
        run += r["v"]
    small = df.select("g").distinct().withColumn("n", F.lit(1))
    for limit in (1, 10_000):
        assert checked_join(df, small, ["g"], salt_on=F.col("id"), limit=limit, salts=4).count() == 2000

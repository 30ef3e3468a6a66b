"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.timestamps import ZONE_LETTERS, normalize_timestamps
from docketry.operators.redelivery import deliver_once, message_identifier, superfluous_copies
from docketry.operators.snapshots import evidence_changes
from docketry.plans.tables import table

#: (table, key, stamp column, zone column)
STAMPS = (("call_log", "call_id", "timestamp_raw", "device_zone"), ("reference_sidecars", "sidecar_no", "fetched_at", None), ("snapshot_entries", "entry_id", "mtime", None))
#: Years in which all instants of these tables lie.
STAMP_YEARS = (2015, 2030)
#: (table, key)
MESSAGES = (("correspondence", "delivery_id"), ("timeline_markers", "marker_id"))


def p1_normalized(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, name).select(F.lit(name).alias("src"), F.col(key).alias("row_id"), F.col(raw).alias("raw"), (F.col(zone) if zone else F.lit(None).cast("string")).alias("zone"))
        for name, key, raw, zone in STAMPS
    ]
    stamps = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return normalize_timestamps(stamps, "raw", zone=F.col("zone"), out="utc_s", status="status", micros="utc_us", years=STAMP_YEARS).drop("zone")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    exact = F.col("raw").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z")
    return p1_normalized(spark, folder).where(F.col("utc_s").isNotNull() & ~exact).select("src", "row_id", "utc_s")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return evidence_changes(table(spark, folder, "snapshot_entries"), STAMP_YEARS)


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p2_found(spark, folder).groupBy("case_id", "snapshot_no", "change_kind").agg(F.count("*").alias("files"))


def _deliveries_of(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Rows of both tables under one key (src, row_id), their identifiers told apart by table, so that one pass over storage serves both."""
    parts = [
        table(spark, folder, name).select(F.struct(F.lit(name).alias("src"), F.col(key).alias("row_id")).alias("key"), F.concat(F.lit(name + "\t"), message_identifier(F.col("message_id"))).alias("ident"), "delivered_at", *extra)
        for name, key in MESSAGES
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return superfluous_copies(_deliveries_of(spark, folder), key="key", ident=F.col("ident"), delivered="delivered_at").select("key.src", "key.row_id")


def p5_once(spark: SparkSession, folder: str) -> DataFrame:
    once = deliver_once(_deliveries_of(spark, folder, "case_id"), key="key", ident=F.col("ident"), delivered="delivered_at")
    return once.select("key.src", "key.row_id", "case_id", F.substring_index("ident", "\t", -1).alias("message_id"))


QUERIES = {"p1_found": p1_found, "p1_normalized": p1_normalized, "p2_found": p2_found, "p2_counts": p2_counts, "p5_found": p5_found, "p5_once": p5_once}

_IDENT = r"""nullif(regexp_replace(message_id, '^[\s<]+|[\s>]+$', '', 'g'), '')"""
_ONE = """SELECT '{t}' AS src, {k} AS row_id, {extra} regexp_replace(i, '@[^@]*$', '') || lower(coalesce(regexp_extract(i, '@[^@]*$'), '')) AS ident, delivered_at, {k} AS key FROM (SELECT *, {i} AS i FROM {t})"""


def _deliveries(extra: str) -> str:
    return " UNION ALL ".join(_ONE.format(t=t, k=k, i=_IDENT, extra=extra) for t, k in MESSAGES)


# stamps in SQL: the families are read by the same shapes, the zones by the engine's own calendar, tried from both sides of the wall clock
_MON = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"
_DOW = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? +)?"
_CLOCK = "(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,]\\d+)?)?(?: ?([ap])\\.?m\\b\\.?)?"
_TAIL = " ?(z|[a-z]{2,4}|(?:utc|gmt)?[+-]\\d{1,2}(?::?\\d{2})?(?::?\\d{2})?|[a-z]+(?:/[a-z0-9_+-]+)+)?(?: ?\\(.*\\))?( ?\\[[a-z0-9/_+-]+\\])?"
_SHAPES = (
    (f"^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}}|\\d{{2}}),? +{_CLOCK}{_TAIL}$", "\\3|\\1|\\2|\\4|\\5|\\6|\\7|\\8|\\9"),
    (f"^(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}}|\\d{{2}}),? +{_CLOCK}{_TAIL}$", "\\3|\\2|\\1|\\4|\\5|\\6|\\7|\\8|\\9"),
    (f"^(\\d{{4}})[-/.](\\d{{1,2}})[-/.](\\d{{1,2}})(?:t|,? +){_CLOCK}{_TAIL}$", "\\1|\\2|\\3|\\4|\\5|\\6|\\7|\\8|\\9"),
    (f"^(\\d{{4}})(\\d{{2}})(\\d{{2}})(?:t| +)(\\d{{2}})(\\d{{2}})(\\d{{2}})?(?:[.,]\\d+)?{_TAIL}$", "\\1|\\2|\\3|\\4|\\5|\\6||\\7|\\8"),
    (f"^{_DOW}{_MON} +(\\d{{1,2}}) +(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})(?: +([a-z]{{3,4}}))? +(\\d{{4}})$", "\\7|\\1|\\2|\\3|\\4|\\5||\\6|"),
    (f"^{_DOW}(\\d{{1,2}})[ -]{_MON}[ -](\\d{{4}}|\\d{{2}}),? +{_CLOCK}{_TAIL}$", "\\3|\\2|\\1|\\4|\\5|\\6|\\7|\\8|\\9"),
    (f"^{_DOW}{_MON} +(\\d{{1,2}})(?:st|nd|rd|th)?,? +(\\d{{4}}),?(?: at)? +{_CLOCK}{_TAIL}$", "\\3|\\1|\\2|\\4|\\5|\\6|\\7|\\8|\\9"),
)
_LETTERS = " ".join(f"WHEN '{k.lower()}' THEN {v * 60}" for k, v in ZONE_LETTERS.items())
_STAMPS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS src, {k} AS row_id, CAST({r} AS VARCHAR) AS raw, {z or 'CAST(NULL AS VARCHAR)'} AS zone FROM {t}" for t, k, r, z in STAMPS)
_INSTANTS = rf"""st AS ({_STAMPS_SQL}),
 c AS (SELECT *, lower(trim(regexp_replace(raw, '[\s\x{{A0}}\x{{2007}}\x{{202F}}\x{{FEFF}}\x{{200E}}|]+', ' ', 'g'))) AS s FROM st),
 g AS (SELECT *, string_split(CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_replace(s, '{p}', '{r}')" for p, r in _SHAPES)} END, '|') AS p, CASE WHEN regexp_full_match(s, '\d{{9,19}}(\.\d*)?') THEN CAST(split_part(s, '.', 1) AS HUGEINT) END AS w FROM c),
 h AS (SELECT *, CASE WHEN length(p[1]) = 2 THEN 2000 ELSE 0 END + try_cast(p[1] AS INTEGER) AS y, coalesce(try_cast(p[2] AS INTEGER), (instr('janfebmaraprmayjunjulaugsepoctnovdec', left(p[2], 3)) + 2) // 3) AS m, try_cast(p[3] AS INTEGER) AS d, try_cast(p[4] AS INTEGER) AS h24, try_cast(p[5] AS INTEGER) AS mi,
   coalesce(try_cast(p[6] AS INTEGER), 0) AS sec, p[7] AS half, coalesce(p[8], '') AS z, regexp_replace(coalesce(p[9], ''), '[\[\] ]', '', 'g') AS br FROM g),
 i AS (SELECT *, CASE WHEN half IN ('a', 'p') THEN CASE WHEN h24 BETWEEN 1 AND 12 THEN h24 % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END ELSE h24 END AS hh, CASE WHEN regexp_matches(z, '[+-]\d') THEN regexp_replace(z, '[a-z:]', '', 'g') END AS sd FROM h),
 j AS (SELECT *, CASE WHEN hh BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND sec BETWEEN 0 AND 59 THEN epoch(try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE))::BIGINT + hh * 3600 + mi * 60 + sec END AS l, CASE WHEN length(sd) % 2 = 0 THEN '0' ELSE '' END || substr(sd, 2, 6) AS dg FROM i),
 k AS (SELECT *, CASE WHEN sd IS NOT NULL THEN CASE WHEN CAST(dg[1:2] AS INTEGER) <= 18 AND coalesce(try_cast(dg[3:4] AS INTEGER), 0) <= 59 THEN CASE WHEN left(sd, 1) = '-' THEN -1 ELSE 1 END * (CAST(dg[1:2] AS INTEGER) * 3600 + coalesce(try_cast(dg[3:4] AS INTEGER), 0) * 60 + coalesce(try_cast(dg[5:6] AS INTEGER), 0)) END
    WHEN NOT contains(z, '/') THEN CASE z {_LETTERS} END END AS o,
   CASE WHEN contains(z, '/') THEN z WHEN z = '' THEN CASE WHEN contains(br, '/') OR br IN ('utc', 'gmt') THEN br ELSE lower(coalesce(nullif(trim(zone), ''), 'utc')) END END AS zn FROM j),
 tz AS (SELECT lower(name) AS zn, min(name) AS name FROM pg_timezone_names() GROUP BY 1),
 n AS (SELECT k.*, name, make_timestamp(l * 1000000) AS lt FROM k LEFT JOIN tz ON tz.zn = k.zn AND k.o IS NULL AND k.l IS NOT NULL),
 q AS (SELECT *, CASE WHEN name IS NOT NULL THEN l - (epoch(timezone(name, (lt - INTERVAL 36 HOUR) AT TIME ZONE 'UTC')) - epoch(lt - INTERVAL 36 HOUR))::BIGINT END AS u1, CASE WHEN name IS NOT NULL THEN l - (epoch(timezone(name, (lt + INTERVAL 36 HOUR) AT TIME ZONE 'UTC')) - epoch(lt + INTERVAL 36 HOUR))::BIGINT END AS u2 FROM n),
 v AS (SELECT *, list_distinct(list_filter([u1, u2], lambda u: u IS NOT NULL AND epoch(timezone(name, to_timestamp(u)))::BIGINT = l)) AS us FROM q),
 x AS (SELECT src, row_id, raw, coalesce({", ".join(f"CASE WHEN w // {f} BETWEEN 1420070400 AND 1924991999 THEN (w // {f})::BIGINT END" for f in (1, 1000, 1000000, 1000000000))}, l - o, CASE WHEN len(us) = 1 THEN us[1] END) AS t FROM v),
 instants AS (SELECT src, row_id, raw, CASE WHEN t BETWEEN 1420070400 AND 1924991999 THEN t END AS utc_s FROM x)"""
_EXACT = r"regexp_full_match(raw, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ')"
_CHANGES = rf"""{_INSTANTS},
 e AS (SELECT s.case_id, s.snapshot_no, s.path, i.utc_s AS mt, CASE WHEN regexp_full_match(hx, '[0-9a-f]{{1,64}}') THEN lpad(hx, 64, '0') END AS sha, row_number() OVER (PARTITION BY s.case_id, s.snapshot_no, s.path ORDER BY s.loaded_at DESC, s.entry_id DESC) AS rn
   FROM (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(sha256, '\s', '', 'g')), '^(sha-?256:|0x)', ''), '^0+(.)', '\1') AS hx FROM snapshot_entries WHERE case_id IS NOT NULL AND snapshot_no IS NOT NULL) s JOIN instants i ON i.src = 'snapshot_entries' AND i.row_id = s.entry_id),
 a AS (SELECT * FROM e WHERE rn = 1), nums AS (SELECT case_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY case_id ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT case_id, snapshot_no FROM a)),
 old AS (SELECT a.case_id, n.snapshot_no, path, mt, sha FROM a JOIN nums n ON n.case_id = a.case_id AND n.prev = a.snapshot_no), new AS (SELECT a.* FROM a JOIN nums n ON n.case_id = a.case_id AND n.snapshot_no = a.snapshot_no AND n.prev IS NOT NULL),
 both_sides AS (SELECT coalesce(new.case_id, old.case_id) AS case_id, coalesce(new.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(new.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN new.sha <> old.sha OR new.mt <> old.mt THEN 'changed' END AS change_kind
   FROM new FULL OUTER JOIN old ON new.case_id = old.case_id AND new.snapshot_no = old.snapshot_no AND new.path = old.path),
 changes AS (SELECT * FROM both_sides WHERE change_kind IS NOT NULL)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_INSTANTS} SELECT src, row_id, utc_s FROM instants WHERE utc_s IS NOT NULL AND NOT {_EXACT}",
    "p2_found": f"WITH {_CHANGES} SELECT * FROM changes",
    "p2_counts": f"WITH {_CHANGES} SELECT case_id, snapshot_no, change_kind, count(*) AS files FROM changes GROUP BY ALL",
    "p5_found": f"SELECT src, row_id FROM ({_deliveries('')}) WHERE ident IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src, ident ORDER BY delivered_at, key) > 1",
    "p5_once": f"SELECT src, row_id, case_id, ident AS message_id FROM ({_deliveries('case_id,')}) QUALIFY ident IS NULL OR row_number() OVER (PARTITION BY src, ident ORDER BY delivered_at, key) = 1",
}

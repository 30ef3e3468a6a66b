"""Queries of reports, checks, orders and readers, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import mail, metadata, text, values
from docketry.operators import checks, documents, integrity, pages, reports, scrub, threads, timeline
from docketry.plans.evidence import TERMS
from docketry.plans.tables import table
from docketry.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# summaries and keys ------------------------------------------------------------------------------


@query(r"""
SELECT count(*) FILTER (n > 0) AS files, CAST(sum(n) AS BIGINT) AS changes FROM (SELECT len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM extraction_results WHERE text IS NOT NULL)""")
def q46_scrub_summary(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "extraction_results").where(F.col("text").isNotNull()).select("extraction_id", "text")
    changes = scrub.scrub_report(scrub.scrub(src, "text", mapping=TERMS), "extraction_id")
    return reports.scrub_summary(changes.where(F.col("detector") == "email"), "extraction_id")


@query("SELECT c.case_id, coalesce(max(delivery_id) + 1, 0) AS next_id FROM (SELECT DISTINCT case_id FROM snapshot_entries) c LEFT JOIN (SELECT * FROM correspondence WHERE delivery_id % 4 = 0) m ON m.case_id = c.case_id GROUP BY 1")
def q47_next_ids(spark: SparkSession, d: str) -> DataFrame:
    return checks.next_ids(table(spark, d, "correspondence").where(F.col("delivery_id") % 4 == 0), table(spark, d, "snapshot_entries"), group="case_id", ident="delivery_id")


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS blob FROM events),
 t AS (SELECT user_id, blob, last_value(blob IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e)
SELECT user_id, count(*) AS commits, count(*) FILTER (prev IS NOT NULL AND blob IS DISTINCT FROM prev) AS content_changes FROM t GROUP BY 1""")
def q48_content_changes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("blob"))
    return reports.change_counts(integrity.change_trail(e, path="user_id", order=["ts", "event_id"], blob="blob"), path="user_id")


# orders ------------------------------------------------------------------------------------------


@query("SELECT marker_id, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(marker_date, ''), kind, title, marker_id) AS place FROM timeline_markers")
def q49_timeline_order(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "timeline_markers").select("marker_id", "case_id", "marker_date", "kind", "title")
    return timeline.timeline_places(m, scope="case_id", key="marker_id").select("marker_id", "place")


@query("SELECT delivery_id, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(date_iso, ''), coalesce(message_id, ''), delivery_id) AS place FROM correspondence")
def q50_correspondence_order(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "correspondence").select("delivery_id", "case_id", "date_iso", "message_id")
    return timeline.message_places(m, scope="case_id", key="delivery_id", date="date_iso", ident="message_id").select("delivery_id", "place")


@query("""
SELECT icon, coalesce(string_agg(display_name, ' | ' ORDER BY (role = 'self') IS NOT TRUE, lower(display_name), display_name), '') AS cards, count(display_name) AS n FROM entities GROUP BY 1""")
def q51_party_buckets(spark: SparkSession, d: str) -> DataFrame:
    return checks.bucketed(table(spark, d, "entities"), bucket="icon", first=F.col("role") == "self", name=F.col("display_name"))


@query("""
SELECT path, 'email' AS kind, CAST(NULL AS VARCHAR) AS source_manifest FROM extraction_results WHERE method = 'stdlib-email'
UNION ALL SELECT raw_path, coalesce(nullif(CASE WHEN sidecar_no % 3 = 0 THEN '' ELSE kind END, ''), 'unknown'), CASE WHEN sidecar_no % 2 = 0 THEN 'own' ELSE 'sidecars' END FROM reference_sidecars""")
def q52_external_manifests(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "extraction_results").where(F.col("method") == "stdlib-email").select("path", F.lit("email").alias("kind"))
    n = F.col("sidecar_no")
    ext = table(spark, d, "reference_sidecars").select(F.col("raw_path").alias("path"), F.when(n % 3 == 0, "").otherwise(F.col("kind")).alias("kind"), F.when(n % 2 == 0, "own").alias("source_manifest"))
    return reports.with_external(own, ext, name="sidecars").select("path", "kind", "source_manifest")


# roles, lookups, checks --------------------------------------------------------------------------


@query("SELECT DISTINCT role FROM entities WHERE role IN ('adversary', 'self', 'regulator')")
def q53_sensitive_roles(spark: SparkSession, d: str) -> DataFrame:
    return checks.sensitive_roles(table(spark, d, "entities"), "role", ["adversary", "self", "regulator"])


@query("""
SELECT jurisdiction, kind, arg_min(citation, sidecar_no) AS citation, min(sidecar_no) AS sidecar_no FROM (SELECT *, CASE WHEN sidecar_no % 4 = 0 THEN 'TODO ' || title WHEN sidecar_no % 4 = 1 THEN '' ELSE title END AS name FROM reference_sidecars)
WHERE coalesce(name, '') <> '' AND NOT starts_with(name, 'TODO') GROUP BY ALL""")
def q54_first_populated(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sidecar_no")
    rows = table(spark, d, "reference_sidecars").withColumn("name", F.when(n % 4 == 0, F.concat(F.lit("TODO "), "title")).when(n % 4 == 1, "").otherwise(F.col("title")))
    return checks.first_populated(rows, group=["jurisdiction", "kind"], order="sidecar_no", name="name", keep=["citation", "sidecar_no"])


@query(r"""
WITH s AS (SELECT entry_id, snapshot_no, case_id || '/' || path AS k, coalesce(lower(trim(sha256)), '') AS h, xattrs IS NOT NULL AS x FROM snapshot_entries),
 f AS (SELECT k, max_by(h, (snapshot_no, entry_id)) AS h, max_by(x, (snapshot_no, entry_id)) AS live FROM s GROUP BY 1),
 m AS (SELECT k, max_by(h, entry_id) AS rec FROM s WHERE entry_id % 5 <> 0 AND snapshot_no = 1 GROUP BY 1),
 t AS (SELECT k, h, last_value(h) OVER (PARTITION BY k ORDER BY snapshot_no, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
 c AS (SELECT k, count(*) AS n, count(*) FILTER (prev IS NOT NULL AND h <> prev) AS cc FROM t GROUP BY 1),
 d AS (SELECT k, count(*) FILTER (x) AS sn FROM s GROUP BY 1)
SELECT k AS path, lower(regexp_extract(regexp_extract(k, '[^/]+$'), '[^.](\.[^.]+)$', 1)) AS extension, concat_ws('; ', CASE WHEN cc > 0 THEN 'git: ⚠ ' || cc || ' content edit(s)' WHEN n = 1 THEN 'git: add-only ✓' ELSE 'git: ' || n || ' commits (renames only) ✓' END,
 CASE WHEN rec IS NULL THEN 'hash: ⚠ not in manifest' WHEN rec = h THEN 'hash: matches manifest ✓' ELSE 'hash: ⚠ MISMATCH' END,
 CASE WHEN live AND sn > 0 THEN 'xattr: live + ' || sn || ' snapshot(s) ✓' WHEN sn > 0 THEN 'xattr: snapshot-only (' || sn || ')' WHEN live THEN 'xattr: live-only (not yet snapshotted)' ELSE 'xattr: none' END) AS line,
 CASE WHEN rec <> h THEN 'fail' WHEN cc > 0 OR rec IS NULL OR (NOT live AND sn = 0) THEN 'warn' ELSE 'pass' END AS verdict
FROM f JOIN c USING (k) JOIN d USING (k) LEFT JOIN m USING (k)""")
def q55_file_report(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshot_entries").select("entry_id", "snapshot_no", F.concat_ws("/", "case_id", "path").alias("path"), F.coalesce(F.lower(F.trim("sha256")), F.lit("")).alias("sha256"), F.col("xattrs").isNotNull().alias("x"))
    at = F.struct("snapshot_no", "entry_id")
    now = s.groupBy("path").agg(F.max_by("sha256", at).alias("sha256"), F.max_by("x", at).alias("live_present"))
    manifest = reports.last_recorded(s.where((F.col("entry_id") % 5 != 0) & (F.col("snapshot_no") == 1)), order="entry_id")
    trail = integrity.change_trail(s, path="path", order=["snapshot_no", "entry_id"], blob="sha256")
    done = reports.file_report(now, manifest=manifest, trail=trail, snapshots=s.where("x"))
    return done.select("path", "extension", "line", integrity.verdict(F.col("warnings"), worst_wins=True).alias("verdict"))


_HIT = r"""(list_contains(list_transform(coalesce(match_emails, []), lambda q: lower(q)), lower(regexp_extract({h}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}'))) OR len(list_filter(match_names, lambda q: q <> '' AND contains(lower({h}), lower(q)))) > 0)"""


@query(f"""
WITH s AS (SELECT delivery_id, arg_min(entity_no, entity_no) AS sender FROM correspondence c JOIN entities e ON c.case_id = e.case_id WHERE {_HIT.format(h="coalesce(from_addr, '')")} GROUP BY 1),
 r AS (SELECT delivery_id, arg_min(entity_no, entity_no) AS recipient FROM correspondence c JOIN entities e ON c.case_id = e.case_id WHERE {_HIT.format(h="coalesce(to_addr, '')")} GROUP BY 1)
SELECT c.delivery_id, coalesce(sender, 0) AS sender, coalesce(recipient, 0) AS recipient, CASE WHEN a.role = 'adversary' THEN 'inbound' WHEN a.role IN ('self', 'ally') THEN 'outbound' WHEN b.role = 'adversary' THEN 'outbound' WHEN b.role IN ('self', 'ally') THEN 'inbound' ELSE 'correspondence' END AS track
FROM correspondence c LEFT JOIN s USING (delivery_id) LEFT JOIN r USING (delivery_id) LEFT JOIN entities a ON a.entity_no = sender LEFT JOIN entities b ON b.entity_no = recipient""")
def q56_message_tracks(spark: SparkSession, d: str) -> DataFrame:
    c, e = table(spark, d, "correspondence"), table(spark, d, "entities")
    return timeline.message_tracks(c, e, key="delivery_id", case="case_id", sender="from_addr", recipient="to_addr", entity="entity_no", order="entity_no", role="role", emails="match_emails", names="match_names").na.fill(0, ["sender", "recipient"])


@query(r"""
WITH c AS (SELECT delivery_id, delivered_at, from_addr LIKE 'K%' AS mine, coalesce(subject, '') AS t, case_id || '|' || trim(regexp_replace(lower(coalesce(subject, '')), '^(\s*(re|fwd?|aw)\s*:\s*)+', '')) AS root FROM correspondence),
 g AS (SELECT root, arg_max(mine, (delivered_at, delivery_id)) AS last_mine, arg_max(t, (delivered_at, delivery_id)) AS last_t, max(CASE WHEN mine AND length(t) >= 40 AND NOT starts_with(ltrim(t), 'Fwd') THEN (delivered_at, delivery_id) END) AS m, arg_max(delivery_id, (delivered_at, delivery_id)) AS last_id FROM c GROUP BY 1)
SELECT root AS root_id, NOT last_mine AND NOT starts_with(ltrim(last_t), 'Fwd') AS needs_reply, CASE WHEN NOT last_mine AND NOT starts_with(ltrim(last_t), 'Fwd') THEN coalesce(m[2], 0) ELSE 0 END AS prior_reply_id FROM g""")
def q57_thread_replies(spark: SparkSession, d: str) -> DataFrame:
    root = F.concat("case_id", F.lit("|"), threads.message_root(F.col("subject")))
    c = table(spark, d, "correspondence").select("delivery_id", "delivered_at", F.when(F.startswith("from_addr", F.lit("K")), "me").otherwise(F.coalesce("from_addr", F.lit(""))).alias("author"), F.coalesce("subject", F.lit("")).alias("subject"), root.alias("root"))
    done = threads.thread_catalog(c, root="root", order=["delivered_at", "delivery_id"], author="author", text="subject", me="me", skip="Fwd", substantive=40)
    return done.select("root_id", "needs_reply", F.coalesce("prior_reply_id", F.lit(0)).alias("prior_reply_id"))


@query(r"""
WITH x AS (SELECT case_id, path, extraction_id, chr(CAST(65 + (row_number() OVER (PARTITION BY case_id ORDER BY extraction_id) - 1) % 26 AS INTEGER)) AS l1, row_number() OVER (PARTITION BY case_id ORDER BY extraction_id) - 1 AS i FROM extraction_results),
 e AS (SELECT *, CASE WHEN i < 26 THEN l1 ELSE chr(CAST(64 + i // 26 AS INTEGER)) || l1 END AS want, CASE WHEN extraction_id % 9 = 0 THEN 'Z' WHEN i < 26 THEN l1 ELSE chr(CAST(64 + i // 26 AS INTEGER)) || l1 END AS got FROM x),
 j AS (SELECT *, extraction_id % 7 <> 0 AS there, extraction_id % 4 <> 0 AS listed, extraction_id % 11 = 0 AS stale FROM e)
SELECT case_id, extraction_id, unnest(list_filter([CASE WHEN got <> want THEN 'out-of-sequence' END, CASE WHEN NOT there THEN 'missing-source' END, CASE WHEN there AND NOT listed THEN 'not-in-manifest' END, CASE WHEN there AND listed AND stale THEN 'stale-hash' END], lambda c: c IS NOT NULL)) AS code FROM j""")
def q58_packet_errors(spark: SparkSession, d: str) -> DataFrame:
    from docketry.runtime import rank_in_group

    r = table(spark, d, "extraction_results").select("case_id", "extraction_id", F.concat_ws("/", F.col("extraction_id").cast("string"), "path").alias("path"))
    n = F.col("extraction_id")
    e = rank_in_group(r, ["case_id"], ["extraction_id"], "i").withColumn("label", F.when(n % 9 == 0, "Z").otherwise(text.label(F.col("i") - 1)))
    disk = r.where(n % 7 != 0).select("path", F.sha2("path", 256).alias("sha256"))
    manifest = r.where(n % 4 != 0).select("path", F.when(n % 11 == 0, "old").otherwise(F.sha2("path", 256)).alias("sha256"))
    return checks.packet_errors(e, disk, manifest, packet="case_id", order="extraction_id")


@query("""
WITH r AS (SELECT marker_id, case_id, unnest(list_distinct(entity_ids)) AS id FROM timeline_markers)
SELECT marker_id, case_id, id FROM r WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entities e WHERE e.case_id = r.case_id AND e.ref_path = 'parties.' || r.id)""")
def q59_unknown_parties(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "entities").select("case_id", F.regexp_replace("ref_path", r"^parties\.", "").alias("id"))
    return checks.unknown_keys(table(spark, d, "timeline_markers"), known, key="marker_id", scope="case_id", ids="entity_ids", ident="id")


@query(r"""
SELECT entity_no, unnest(list_filter([CASE WHEN NOT regexp_full_match(entity_id, '[a-z0-9][a-z0-9_-]*') THEN 'bad-id' END, CASE WHEN count(*) OVER (PARTITION BY entity_id) > 1 THEN 'repeated-id' END,
 CASE WHEN role IS NULL OR role NOT IN ('neutral', 'adversary', 'ally', 'self') THEN 'bad-role' END, CASE WHEN coalesce(display_name, '') = '' AND coalesce(ref_path, '') = '' THEN 'no-name-or-ref' END,
 CASE WHEN icon <> '' AND icon NOT IN ('person', 'org', 'venue', 'counsel') THEN 'bad-icon' END], lambda c: c IS NOT NULL)) AS code FROM entities""")
def q60_entity_errors(spark: SparkSession, d: str) -> DataFrame:
    return checks.entity_errors(table(spark, d, "entities"), key="entity_no")


@query("""
WITH e AS (SELECT marker_id, case_id, unnest(list_distinct(entity_ids)) AS id FROM timeline_markers WHERE kind = 'event'),
 r AS (SELECT case_id, ref_path[9:] AS id, min(role) AS role FROM entities WHERE starts_with(ref_path, 'parties.') GROUP BY ALL),
 j AS (SELECT e.marker_id, e.id, r.role FROM e LEFT JOIN r USING (case_id, id)),
 g AS (SELECT marker_id, string_agg(id || ':' || coalesce(role, 'neutral'), ',' ORDER BY id || ':' || coalesce(role, 'neutral')) AS parties, bool_or(role = 'adversary') AS a, bool_or(role IN ('self', 'ally')) AS o FROM j GROUP BY 1)
SELECT m.marker_id, CASE WHEN a THEN 'adverse_event' WHEN o THEN 'self_event' ELSE 'neutral_event' END AS track, coalesce(parties, '') AS parties FROM timeline_markers m LEFT JOIN g USING (marker_id) WHERE m.kind = 'event'""")
def q61_event_tracks(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "entities").where(F.startswith("ref_path", F.lit("parties."))).select("case_id", F.regexp_replace("ref_path", r"^parties\.", "").alias("id"), "role")
    events = table(spark, d, "timeline_markers").where(F.col("kind") == "event")
    return timeline.event_tracks(events, known, key="marker_id", scope="case_id", ids="entity_ids", ident="id", role="role")


# pages and documents -----------------------------------------------------------------------------


@query("""
SELECT page_id, CASE WHEN NOT garbled THEN 0 WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 5 = 0 THEN 2 ELSE 0 END AS tier, garbled AND page_id % 3 <> 0 AND page_id % 5 <> 0 AS garbled FROM page_results WHERE page_id IS NOT NULL""")
def q62_page_cascade(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("page_id", "text", "garbled")
    tier = lambda k: p.select("page_id", F.concat(F.lit(f"tier {k} of "), F.col("page_id").cast("string")).alias("text"), (F.col("page_id") % k != 0).alias("garbled"))
    return pages.escalate([p, tier(3), tier(5)], keys=["page_id"]).select("page_id", "tier", "garbled")


@query("""
WITH h AS (SELECT doc_id, left(text, CAST(doc_id % 500 AS INTEGER)) AS a, CASE WHEN doc_id % 4 <> 0 THEN left(text, CAST(doc_id % 900 AS INTEGER)) END AS b, text AS c FROM documents WHERE regexp_full_match(text, '[ -~\\n]*') AND length(text) >= 900 AND regexp_full_match(left(text, 900), '[ -~\\n]*') AND len(list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]{2,}'))) > 0.6 * len(string_split_regex(text, '\\s+')))
SELECT doc_id, length(CASE WHEN length(a) >= 200 THEN a WHEN length(coalesce(b, '')) >= 200 THEN b ELSE c END) AS n, CASE WHEN length(a) >= 200 THEN 0 WHEN length(coalesce(b, '')) >= 200 THEN 1 ELSE 2 END AS tier FROM h""")
def q63_html_cascade(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", r"\s+")
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"^[ -~\n]*\z") & (F.length("text") >= 900) & (F.size(F.filter(words, lambda x: x.rlike("[A-Za-z]{2,}"))) > 0.6 * F.size(words)))
    n = F.col("doc_id")
    docs = docs.select("doc_id", F.left("text", (n % 500).cast("int")).alias("a"), F.when(n % 4 != 0, F.left("text", (n % 900).cast("int"))).alias("b"), F.col("text").alias("c"), F.length("text").alias("raw"))
    return pages.html_cascade(docs, tiers=["a", "b", "c"], raw_length="raw", key="doc_id").select("doc_id", F.length("text").alias("n"), "tier")


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 12 >= 10 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 12 <> 0 THEN 'interpreted' END AS warning FROM orders")
def q64_typed_days(spark: SparkSession, d: str) -> DataFrame:
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yy", "MM-dd-yyyy", "M-d-yy", "MMMM d yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM yyyy", "MMM yyyy"]
    typed = F.coalesce(*[F.when(F.col("o_orderkey") % 12 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)])
    got = table(spark, d, "orders").select("o_orderkey", values.typed_day(typed).alias("t"))
    return got.select("o_orderkey", F.col("t.value").alias("day"), F.col("t.warning").alias("warning"))


@query("""
WITH l AS (SELECT *, regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS h FROM reference_sidecars)
SELECT sidecar_no FROM l WHERE sidecar_no % 3 <> 0 AND h <> '' AND h NOT IN (SELECT h FROM l WHERE sidecar_no % 3 = 0)""")
def q65_stale_hosts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sidecars")
    return checks.stale_hosts(r.where(F.col("sidecar_no") % 3 != 0), r.where(F.col("sidecar_no") % 3 == 0), url="source_url").select("sidecar_no")


@query("""
SELECT sha256(text) AS blob, min(doc_id) AS first, count(*) AS copies, concat_ws(',', CASE WHEN contains(text, 'Verrid Indemnity') THEN 'Verrid Indemnity' END, CASE WHEN contains(text, 'hatchback') THEN 'hatchback' END) AS terms
FROM documents WHERE contains(text, 'Verrid Indemnity') OR contains(text, 'hatchback') GROUP BY text""")
def q66_history_survivors(spark: SparkSession, d: str) -> DataFrame:
    return checks.history_survivors(table(spark, d, "documents"), scrub.banned_terms({"Verrid Indemnity": "x"}, ["hatchback"]), content="text", order="doc_id")


@query("SELECT entry_id, array_to_string(list_sort(list_filter(map_keys(xattrs), lambda k: coalesce(xattrs[k], '') <> '' AND NOT (k = 'user.origin' AND xattrs[k] = 'scan'))), ',') AS names FROM snapshot_entries WHERE xattrs IS NOT NULL")
def q67_metadata_survivors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshot_entries").where(F.col("xattrs").isNotNull())
    return s.select("entry_id", checks.metadata_survivors(F.col("xattrs"), {"user.origin": "scan"}).alias("names"))


@query(r"""
SELECT extraction_id, CASE WHEN e IN ('.eml', '.txt') AND starts_with(path, 'evidence/emails/') THEN 'mail' WHEN e IN ('.pdf') AND starts_with(path, 'evidence/') THEN 'pages' WHEN e IN ('.html') AND starts_with(path, 'evidence/web/') THEN 'web' END AS handler,
 CASE WHEN e IN ('.eml', '.txt') AND starts_with(path, 'evidence/emails/') THEN 'mail by ' || method WHEN e IN ('.pdf') AND starts_with(path, 'evidence/') THEN 'tier ' || tier END AS handled, CASE WHEN e IN ('.html') AND starts_with(path, 'evidence/web/') THEN 'unknown handler: web' END AS warning
FROM (SELECT *, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS e FROM extraction_results)""")
def q68_dispatch(spark: SparkSession, d: str) -> DataFrame:
    rules = [([".eml", ".txt"], "evidence/emails", "mail"), ([".pdf"], "evidence", "pages"), ([".html"], "evidence/web", "web")]
    handlers = {"mail": lambda df: F.concat(F.lit("mail by "), df["method"]), "pages": lambda df: F.concat(F.lit("tier "), df["tier"].cast("string"))}
    return documents.dispatched(table(spark, d, "extraction_results"), rules, handlers).select("extraction_id", "handler", "handled", "warning")


# readers -----------------------------------------------------------------------------------------


@query(r"""
SELECT delivery_id, message_id, subject, regexp_extract(from_addr, '([^<> ]+@[^<> ]+)', 1) AS sender, regexp_extract(to_addr, '([^<> ]+@[^<> ]+)', 1) AS recipient, 'body of ' || delivery_id AS body, 'attachment-' || left(sha256('note ' || delivery_id), 8) AS attached, 'From: ' || trim(from_addr) AS first_line
FROM correspondence WHERE regexp_full_match(from_addr, '[A-Za-z ]+<[^<> ]+>') AND regexp_full_match(to_addr, '[A-Za-z ]+<[^<> ]+>') AND regexp_full_match(subject, '[!-~]+( [!-~]+)*') AND length(subject) < 60 AND regexp_full_match(message_id, '<[!-;=?-~]+@[a-z0-9.-]+>') AND length(message_id) < 60""")
def q69_mail_parse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "correspondence").where(F.col("from_addr").rlike(r"^[A-Za-z ]+<[^<> ]+>\z") & F.col("to_addr").rlike(r"^[A-Za-z ]+<[^<> ]+>\z") & F.col("subject").rlike(r"^[!-~]+( [!-~]+)*\z") & (F.length("subject") < 60) & F.col("message_id").rlike(r"^<[!-;=?-~]+@[a-z0-9.-]+>\z") & (F.length("message_id") < 60))
    key = F.col("delivery_id").cast("string")
    head = F.concat(F.lit("Message-ID: "), "message_id", F.lit("\nFrom: "), "from_addr", F.lit("\nTo: "), "to_addr", F.lit("\nSubject: "), "subject", F.lit('\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nbody of '), key)
    raw = F.concat(head, F.lit("\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment\n\nnote "), key, F.lit("\n--b--\n")).cast("binary")
    m = c.select("delivery_id", mail.parsed(raw).alias("m"))
    line = F.substring_index(mail.transcript(F.col("m")), "\n", 1)
    return m.select("delivery_id", "m.message_id", "m.subject", F.col("m.from")[0]["email"].alias("sender"), F.col("m.to")[0]["email"].alias("recipient"), F.trim(F.regexp_replace("m.body_text", "\n", "")).alias("body"), F.col("m.attachments")[0]["filename"].alias("attached"), line.alias("first_line"))


@query("""
SELECT entry_id, (epoch_ms(CAST(captured_at AS TIMESTAMP)) // 1000) AS downloaded, 'app' || entry_id % 3 AS application, 'https://host.example/' || entry_id AS origin, CASE entry_id % 5 WHEN 0 THEN 'local machine' WHEN 1 THEN 'local intranet' WHEN 2 THEN 'trusted sites' WHEN 3 THEN 'internet' ELSE 'restricted sites' END AS zone FROM snapshot_entries""")
def q70_file_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshot_entries").select("entry_id", F.col("captured_at").cast("timestamp").alias("at"))
    key = F.col("entry_id").cast("string")
    mark = F.concat(F.lit("0083;"), F.lower(F.hex(F.unix_seconds("at"))), F.lit(";app"), (F.col("entry_id") % 3).cast("string"), F.lit(";id"))
    url = F.concat(F.lit("https://host.example/"), key)
    ini = F.concat(F.lit("[ZoneTransfer]\r\nZoneId="), (F.col("entry_id") % 5).cast("string"), F.lit("\r\nHostUrl="), url, F.lit("\r\n"))
    q, z = metadata.quarantine(mark), metadata.zone_identifier(ini)
    first = metadata.origins(metadata.where_from(url), F.array(F.trim(z["host_url"])))
    return s.select("entry_id", F.unix_seconds(q["downloaded_at"]).alias("downloaded"), q["application"].alias("application"), F.array_join(first, ",").alias("origin"), F.trim(z["zone"]).alias("zone"))


@query("""
SELECT path, arg_max(h, entry_id) AS sha256 FROM (SELECT entry_id, path, coalesce(nullif(regexp_replace(sha256, '\\s', '', 'g'), ''), 'x') AS h FROM snapshot_entries WHERE entry_id % 6 <> 0 AND entry_id % 10 <> 0) WHERE NOT contains(path, '  ') AND path = trim(path) GROUP BY 1""")
def q71_shasum_map(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshot_entries").where(~F.contains("path", F.lit("  ")) & (F.col("path") == F.trim("path")))
    h = F.coalesce(F.nullif(F.regexp_replace("sha256", r"\s", ""), F.lit("")), F.lit("x"))
    line = F.when(F.col("entry_id") % 6 == 0, F.concat(F.lit("# "), h, F.lit("  "), "path")).when(F.col("entry_id") % 10 == 0, F.concat_ws(" ", h, "path")).otherwise(F.concat_ws("  ", h, "path"))
    numbered = s.select(line.alias("value"), "entry_id")
    parts = files.shasum_lines(numbered, keep=["entry_id"])
    return reports.last_recorded(parts, order="entry_id").select("path", "sha256")


@query("""
SELECT l_returnflag AS provider, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) FILTER (l_linenumber <> 3) AS VARCHAR) AS billed, CAST(coalesce(sum(CAST(l_tax AS DECIMAL(18, 2))), 0) AS VARCHAR) AS allowed, CAST(0 AS VARCHAR) || '.00' AS patient_responsibility FROM lineitem GROUP BY 1""")
def q72_benefit_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    price = F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)))
    rows = li.select(F.date_format("l_shipdate", "M/d/yyyy").alias("date_of_service"), F.col("l_returnflag").alias("provider"), price.alias("billed"), F.col("l_tax").cast("decimal(18,2)").cast("string").alias("allowed"), F.col("l_shipmode").alias("ship") if "l_shipmode" in li.columns else F.lit("x").alias("ship"))
    done = files.benefit_totals(files.benefit_rows(rows), ["provider"])
    return done.select("provider", *[F.col(c).cast("string").alias(c) for c in files.BENEFIT[4:]])


@query("""
SELECT call_id, CASE WHEN call_id % 3 = 1 THEN 'incoming' WHEN call_id % 3 = 2 THEN 'outgoing' ELSE 'unknown' END AS direction, number AS address, nullif(name, '') AS contact_name, strftime(CAST(loaded_at AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S+00:00') AS date_iso FROM call_log""")
def q73_sms_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "call_log")
    rows = c.select(F.col("call_id").cast("string").alias("_body"), (F.col("call_id") % 3).cast("string").alias("_type"), F.col("number").alias("_address"), F.col("name").alias("_contact_name"), F.unix_millis(F.col("loaded_at").cast("timestamp")).cast("string").alias("_date"), F.lit("").alias("_thread_id"))
    return files.sms_rows(rows).select(F.col("body").cast("bigint").alias("call_id"), "direction", "address", "contact_name", "date_iso")


@query("""
WITH c AS (SELECT delivery_id // 5 AS batch, CASE WHEN delivery_id % 4 = 0 THEN 'M' ELSE 'A' END AS status, CASE WHEN delivery_id % 3 = 0 THEN 'evidence/x' WHEN delivery_id % 7 = 0 THEN 'evidence/manifest' ELSE 'notes/x' END AS path FROM correspondence)
SELECT batch, count(*) FILTER (path = 'evidence/x' AND status <> 'A') AS refused, count(*) FILTER (path = 'evidence/x' AND status = 'A') AS additions, count(*) FILTER (path = 'evidence/x' AND status = 'A') > 0 AND count(*) FILTER (path = 'evidence/manifest') = 0 AS manifest_missing FROM c GROUP BY 1""")
def q74_commit_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("delivery_id")
    c = table(spark, d, "correspondence").select(F.floor(n / 5).cast("bigint").alias("batch"), F.when(n % 4 == 0, "M").otherwise("A").alias("status"), F.when(n % 3 == 0, "evidence/x").when(n % 7 == 0, "evidence/manifest").otherwise("notes/x").alias("path"))
    return checks.commit_gate(c, commit="batch", protected=["evidence/"], manifest="evidence/manifest")


@query(r"""
SELECT doc_id, regexp_matches(t, '\b(evidence|references)/[\w./-]+') AND NOT regexp_matches(t, '\[source: [^\]]+\]') AS uncited, CASE WHEN doc_id % 5 = 0 THEN 'edit_proposal-missing-keys' WHEN doc_id % 5 = 1 THEN 'find-empty' ELSE '' END AS edit_code,
 doc_id % 2 = 0 OR doc_id % 3 = 0 AS stub, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS insertions, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 100 + 2 END AS next_revision
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'see evidence/a.txt' WHEN doc_id % 4 = 1 THEN 'see evidence/a.txt [source: a]' ELSE 'see nothing' END AS t FROM documents)""")
def q75_reply_checks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    body = F.when(n % 4 == 0, "see evidence/a.txt").when(n % 4 == 1, "see evidence/a.txt [source: a]").otherwise("see nothing")
    find, put = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 5 == 1, "").otherwise("see"), F.lit("note")
    markup = F.when(n % 3 != 0, documents.tracked(F.lit("see this"), F.lit("this"), F.lit("that"), F.lit("Al"), n % 100)).otherwise(F.lit("see this"))
    stub = checks.is_stub(F.when(n % 2 == 0, "TODO").otherwise("populated"), F.when(n % 3 == 0, "todo").otherwise("IC"), F.lit("Code"))
    return table(spark, d, "documents").select("doc_id", checks.footer_missing(body).alias("uncited"), checks.edit_code(find, put).alias("edit_code"), stub.alias("stub"), documents.revision_counts(markup, "Al")["insertions"].alias("insertions"), documents.next_revision(markup).alias("next_revision"))


@query("""
SELECT extraction_id, CASE WHEN extraction_id % 5 = 0 THEN 'source-changed' WHEN extraction_id % 3 = 0 AND coalesce(text, '') <> '' THEN 'text-changed' ELSE 'same' END AS replay FROM extraction_results""")
def q76_recipes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "extraction_results")
    n, h = F.col("extraction_id"), F.sha2("path", 256)
    made = reports.recipe(source_id=F.left(h, F.lit(16)), sha256=h, text=F.col("text"), method=F.col("method"))
    now = F.when(n % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return r.select("extraction_id", reports.replayed(made, sha256=F.when(n % 5 == 0, "other").otherwise(h), text=now).alias("replay"))


@query("""
WITH t AS (SELECT sidecar_no, '---' || chr(10) || 'kind: ' || kind || chr(10) || 'state: ' || coalesce(jurisdiction, '') || chr(10) || 'other: x' || chr(10) || '---' || chr(10) || 'kind: body' AS t, kind, jurisdiction FROM reference_sidecars)
SELECT sidecar_no, kind AS kind_, nullif(coalesce(jurisdiction, ''), '') AS state FROM t""")
def q77_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("---\nkind: "), "kind", F.lit("\nstate: "), F.coalesce("jurisdiction", F.lit("")), F.lit("\nother: x\n---\nkind: body"))
    m = table(spark, d, "reference_sidecars").select("sidecar_no", documents.frontmatter(t, ["kind", "state", "none"]).alias("m"))
    return m.select("sidecar_no", F.try_element_at("m", F.lit("kind")).alias("kind_"), F.try_element_at("m", F.lit("state")).alias("state"))


@query(r"""
WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT sidecar_no, regexp_replace(left(regexp_replace(regexp_replace(lower(CASE WHEN sidecar_no % 3 = 0 THEN citation WHEN sidecar_no % 3 = 1 THEN regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') || '-' || regexp_extract(source_url, '^[a-z]+://[^/]+([^?#]*)', 1) ELSE regexp_replace(regexp_extract(raw_path, '[^/]+$'), '\.[^.]*$', '') END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS slug,
 CASE WHEN sidecar_no % 2 = 0 THEN 'text/html' WHEN ends_with(raw_path, '.html') THEN 'text/html' WHEN ends_with(raw_path, '.pdf') THEN 'application/pdf' WHEN ends_with(raw_path, '.txt') THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type FROM reference_sidecars""")
def q78_reference_slugs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sidecars")
    n = F.col("sidecar_no")
    slug = documents.reference_slug(F.when(n % 3 == 0, F.col("citation")), F.when(n % 3 == 1, F.col("source_url")), F.when(n % 3 == 2, F.col("raw_path")))
    return r.select("sidecar_no", slug.alias("slug"), text.content_type(F.when(n % 2 == 0, "Text/HTML; charset=x"), F.col("raw_path")).alias("content_type"))


@query("""
SELECT page_id, extraction_id FROM page_results WHERE page_number NOT IN (2, 5)""")
def q79_finished_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents.finished(table(spark, d, "page_results"), skip=[2, 5], strip=[r"Page \d+", "(unclosed"]).select("page_id", "extraction_id")


@query(r"""
SELECT entry_id, marker_id FROM (SELECT marker_id, 'see ' || regexp_extract(path, '[^/]+$') || ' there' AS line FROM timeline_markers JOIN (SELECT extraction_id, path FROM extraction_results) x ON x.extraction_id = marker_id) l
JOIN (SELECT extraction_id AS entry_id, path FROM extraction_results) f ON list_contains(string_split(l.line, ' '), regexp_extract(f.path, '[^/]+$'))""")
def q80_mentions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "extraction_results").select("extraction_id", "path")
    lines = table(spark, d, "timeline_markers").select("marker_id").join(x, F.col("marker_id") == F.col("extraction_id")).select(F.concat(F.col("marker_id").cast("string"), F.lit(" see "), text.basename(F.col("path")), F.lit(" there")).alias("line"))
    known = x.select(F.concat_ws("|", F.col("extraction_id").cast("string"), "path").alias("path"))
    named = known.withColumn("path", F.col("path"))
    hits = documents.mentions(lines, named.select(F.col("path")), path="path")
    return hits.select(F.substring_index("path", "|", 1).cast("bigint").alias("entry_id"), F.substring_index("line", " ", 1).cast("bigint").alias("marker_id"))


@query("""
SELECT call_id, concat_ws(chr(10), CASE WHEN concat_ws(' ', nullif(name, ''), CASE WHEN number <> '' THEN '<' || number || '>' END) <> '' THEN 'From: ' || concat_ws(' ', nullif(name, ''), CASE WHEN number <> '' THEN '<' || number || '>' END) END, CASE WHEN direction <> '' THEN 'Direction: ' || direction END, CASE WHEN duration_seconds IS NOT NULL THEN 'Seconds: ' || duration_seconds END, CASE WHEN transcript <> '' THEN chr(10) || transcript END) AS shown FROM call_log""")
def q81_call_texts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "call_log").select("call_id", documents.call_text(F.col("number"), F.col("name"), F.col("direction"), none, F.col("duration_seconds"), F.col("transcript")).alias("shown"))


@query("SELECT c_custkey, c_name || chr(10) || concat_ws(', ', n_name, CASE WHEN c_custkey % 2 = 0 THEN 'MD' END, CAST(c_custkey AS VARCHAR)) AS address FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q82_addresses(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", values.address_text(F.col("c_name"), F.col("n_name"), F.when(F.col("c_custkey") % 2 == 0, "MD").otherwise(""), F.col("c_custkey").cast("string")).alias("address"))


# text marks, dates, readers of small forms --------------------------------------------------------


@query(r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'F+Q' WHEN 1 THEN 'A' WHEN 2 THEN 'S' ELSE '' END AS tag, CASE WHEN doc_id % 4 = 3 THEN 'no: tail' ELSE 'tail' END AS tail, replace(replace(kind, ' ', '-'), '_', '-') || '-x' AS slug,
 left(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' '), 80) AS snippet, strftime(received_at, 'D:%Y%m%d%H%M%SZ') AS pdf_date, round(n_chars / nullif(doc_id % 7, 0), 6) AS per_page, coalesce(n_chars / nullif(doc_id % 7, 0) < 200, false) AS low,
 CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 END AS whole FROM documents""")
def q83_text_marks(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import snippet

    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, " q+f: tail").when(n % 4 == 1, "a: tail").when(n % 4 == 2, "S:tail").otherwise("no: tail")
    tag, tail = text.tag(raw)
    per = documents.fidelity(F.col("n_chars"), n % 7)
    return table(spark, d, "documents").select(
        "doc_id", tag.alias("tag"), tail.alias("tail"), text.title_slug(F.concat("kind", F.lit("_x!"))).alias("slug"), snippet(F.col("text")).alias("snippet"), documents.pdf_date(F.col("received_at")).alias("pdf_date"),
        F.round(per["chars_per_page"], 6).alias("per_page"), F.coalesce(per["low"], F.lit(False)).alias("low"), F.coalesce(values.whole(F.when(n % 2 == 0, F.concat(F.lit(" "), n.cast("string"))).otherwise("x")).cast("bigint"), F.lit(-1)).alias("whole"),
    )


@query(r"""
SELECT delivery_id, strftime(strptime(date_raw, '%a, %d %b %Y %H:%M:%S %z') AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM correspondence WHERE regexp_full_match(date_raw, '[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}')""")
def q84_mail_dates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "correspondence").where(F.col("date_raw").rlike(r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}\z"))
    return c.select("delivery_id", mail.mail_date(F.col("date_raw")).alias("iso"))


@query("""
SELECT delivery_id FROM correspondence WHERE (contains(from_addr, 'Ka') OR contains(from_addr, 'Vera') OR contains(coalesce(to_addr, ''), 'Olaf')) AND (contains(concat_ws(' ', subject, from_addr, to_addr), 'report') OR contains(concat_ws(' ', subject, from_addr, to_addr), 'inbox-hill'))""")
def q85_header_filter(spark: SparkSession, d: str) -> DataFrame:
    from docketry.functions import rules

    cfg = {"headers": {"From": ["Ka", "Vera"], "To": ["Olaf"]}, "identifiers": ["report", "inbox-hill"]}
    heads = F.create_map(F.lit("From"), "from_addr", F.lit("To"), "to_addr")
    none = F.array().cast("array<string>")
    hold = rules.message_predicate(cfg, addresses=none, subject=F.col("subject"), body=F.lit(""), headers=heads, day=F.lit(None).cast("date"))
    return table(spark, d, "correspondence").where(hold).select("delivery_id")


@query(r"""
SELECT extraction_id, CASE WHEN extraction_id % 5 = 0 THEN 'application/msword' WHEN ends_with(path, '.html') THEN 'text/html' WHEN ends_with(path, '.pdf') THEN 'application/pdf' WHEN ends_with(path, '.txt') THEN 'text/plain' WHEN ends_with(path, '.md') THEN 'text/markdown' ELSE 'application/octet-stream' END AS kind, extraction_id % 5 = 0 AS refused,
 CASE WHEN extraction_id % 5 <> 0 AND ends_with(path, '.html') THEN 'Page ' || extraction_id || chr(10) || 'see x (http://h/' || tier || ')' || chr(10) WHEN extraction_id % 5 <> 0 AND (ends_with(path, '.txt') OR ends_with(path, '.md')) THEN 'plain' ELSE '' END AS shown, CASE WHEN extraction_id % 5 <> 0 AND ends_with(path, '.html') THEN 'T' || tier ELSE '' END AS title FROM extraction_results""")
def q86_reference_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("extraction_id").cast("string")
    page = F.concat(F.lit("<head><meta charset=utf-8><title>T"), F.col("tier").cast("string"), F.lit("</title></head><p>Page "), n, F.lit("</p><script>no</script>see <a href='http://h/"), F.col("tier").cast("string"), F.lit("'>x</a>"))
    r = table(spark, d, "extraction_results").select("extraction_id", "path", F.when(F.endswith("path", F.lit(".html")), page).otherwise("plain").cast("binary").alias("content"), F.when(F.col("extraction_id") % 5 == 0, "application/msword").alias("content_type"))
    done = documents.reference_text(r)
    return done.select("extraction_id", "kind", "refused", F.coalesce("text", F.lit("")).alias("shown"), F.coalesce("title", F.lit("")).alias("title"))


@query("""
SELECT CASE WHEN entry_id % 3 = 0 THEN 'D' WHEN entry_id % 3 = 1 THEN 'A' ELSE 'M' END AS status, CASE WHEN entry_id % 3 = 0 THEN 'old/' || path ELSE path END AS path, entry_id FROM snapshot_entries UNION ALL SELECT 'A', path, entry_id FROM snapshot_entries WHERE entry_id % 3 = 0""")
def q87_staged_changes(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import changed_files

    n, mark = F.col("entry_id"), F.concat(F.lit("|"), F.col("entry_id").cast("string"))
    c = table(spark, d, "snapshot_entries").select(F.when(n % 3 == 0, "R100").when(n % 3 == 1, "A").otherwise("M").alias("status"), F.concat(F.lit("old/"), "path", mark).alias("old_path"), F.concat("path", mark).alias("path"))
    return changed_files(c).select("status", F.regexp_replace("path", r"\|\d+$", "").alias("path"), F.regexp_extract("path", r"\|(\d+)$", 1).cast("bigint").alias("entry_id"))


@query("""
SELECT entity_no, coalesce(ref_path, '') <> '' AND ref_path NOT IN ('parties.p1', 'parties.p2') AS missing, CASE ref_path WHEN 'parties.p1' THEN 'AFRICA' WHEN 'parties.p2' THEN 'ASIA' ELSE '' END AS name FROM (SELECT entity_no, CASE entity_no % 5 WHEN 0 THEN 'parties.p1' WHEN 1 THEN 'parties.p2' WHEN 2 THEN 'parties.p1.name' ELSE ref_path END AS ref_path FROM entities)""")
def q88_resolved_facts(spark: SparkSession, d: str) -> DataFrame:
    party = lambda name, i: F.struct(F.lit(name).alias("name"), F.lit(i).alias("number"), F.array(F.lit("x")).alias("tags"))
    facts = table(spark, d, "region").where(F.col("r_regionkey") == 0).select(F.struct(F.struct(party("AFRICA", 1).alias("p1"), party("ASIA", 2).alias("p2")).alias("parties"), F.lit("t").alias("title")).alias("facts"))
    n = F.col("entity_no")
    e = table(spark, d, "entities").select("entity_no", F.when(n % 5 == 0, "parties.p1").when(n % 5 == 1, "parties.p2").when(n % 5 == 2, "parties.p1.name").otherwise(F.col("ref_path")).alias("ref_path"))
    done = documents.resolved(e, documents.flattened(facts, "facts"))
    return done.select("entity_no", "missing", F.coalesce(F.try_element_at("resolved", F.lit("name")), F.lit("")).alias("name"))


@query(r"""
WITH t AS (SELECT doc_id, len(string_split(text, chr(10))) AS l FROM documents WHERE regexp_full_match(text, '[ -~\n]*[!-~]') AND length(text) < 4000)
SELECT doc_id, doc_id % 3 = 0 AS same, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 END AS delta, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 + least(2, l) END AS diff_lines, doc_id % 3 <> 0 AND 4 + least(2, l) > 5 AS truncated FROM t""")
def q89_text_diffs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("text").rlike(r"(?s)^[ -~\n]*[!-~]\z") & (F.length("text") < 4000)).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\nend"))).alias("other"))
    return documents.compared(t, "text", "other", limit=5).select("doc_id", "same", "delta", "diff_lines", "truncated")


@query("""
SELECT sidecar_no, source_id, title FROM (SELECT sidecar_no, source_id, title FROM reference_sidecars WHERE sidecar_no % 2 = 0 UNION ALL SELECT sidecar_no, source_id, title FROM reference_sidecars a WHERE sidecar_no % 2 = 1 AND NOT EXISTS (SELECT 1 FROM reference_sidecars b WHERE b.sidecar_no % 2 = 0 AND b.source_id = a.source_id))""")
def q90_keyed_append(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_sidecars").select("sidecar_no", "source_id", "title")
    kept, _ = integrity.append_entries(r.where(F.col("sidecar_no") % 2 == 0), r.where(F.col("sidecar_no") % 2 == 1), "source_id")
    return kept


@query(r"""
WITH l AS (SELECT extraction_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM extraction_results WHERE text IS NOT NULL)
SELECT extraction_id, line, sha256(m) AS original_sha256 FROM (SELECT extraction_id, line, unnest(regexp_extract_all(t, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS m FROM l)""")
def q91_scrub_lines(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "extraction_results").where(F.col("text").isNotNull()).select("extraction_id", "text")
    report = scrub.scrub_report(scrub.scrub(src, "text"), "extraction_id")
    return report.where(F.col("detector") == "email").select("extraction_id", F.col("line").cast("bigint").alias("line"), "original_sha256")


@query("""
SELECT extraction_id, CASE WHEN ends_with(path, '.xml') OR extraction_id % 4 = 0 THEN 'android-xml' WHEN extraction_id % 4 = 1 THEN 'sqlite' WHEN extraction_id % 4 = 2 THEN 'csv' ELSE 'unknown' END AS format FROM extraction_results""")
def q92_export_formats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("extraction_id")
    content = F.when(n % 4 == 0, "<?xml?><smses>").when(n % 4 == 1, "SQLite format 3").otherwise("number,name").cast("binary")
    path = F.when(F.endswith("path", F.lit(".xml")), F.col("path")).when(n % 4 == 2, F.concat("path", F.lit(".CSV"))).otherwise(F.concat("path", F.lit(".bin")))
    return table(spark, d, "extraction_results").select("extraction_id", documents.export_format(path, content).alias("format"))


# references --------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT sha256(text) AS h, min(doc_id) AS doc FROM documents WHERE kind = 'reference' GROUP BY 1), k AS (SELECT doc, left(h, 16) AS sid FROM n WHERE left(h, 16) NOT IN (SELECT left(sha256(text), 16) FROM documents WHERE kind = 'reference' AND doc_id % 10 = 0)),
 s AS (SELECT *, 'ref-' || doc % 7 AS slug, row_number() OVER (PARTITION BY doc % 7 ORDER BY doc) AS i FROM k)
SELECT sid AS source_id, doc AS doc_id, CASE WHEN i > 1 THEN slug || '-' || i ELSE slug END AS slug, length(text) AS chars, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 400 AS short FROM s JOIN documents ON doc_id = doc""")
def q93_reference_ingest(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators import references

    docs = table(spark, d, "documents").where(F.col("kind") == "reference")
    none = F.lit(None).cast("string")
    new = docs.select("doc_id", F.concat(F.lit("ref_"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), none.alias("content_type"), none.alias("citation"), none.alias("url"))
    old = docs.where(F.col("doc_id") % 10 == 0).select(F.left(F.sha2("text", 256), F.lit(16)).alias("source_id"))
    done = references.ingest(new, old, order="doc_id", kind=F.lit("statute"))
    return done.select("source_id", "doc_id", "slug", F.length("text").alias("chars"), F.contains("flags", F.lit("short-for-kind")).alias("short"))


@query("SELECT extraction_id FROM extraction_results WHERE method IN ('stdlib-email', 'html-to-text', 'vlm')")
def q94_consented(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators import references

    consents = spark.createDataFrame([("vlm", True), ("vlm", True), ("tesseract@5", False), (None, True)], "provider string, granted boolean")
    return references.consented(table(spark, d, "extraction_results"), consents, provider="method", local=["stdlib-email", "html-to-text"]).select("extraction_id")


@query("""
SELECT row_number() OVER (ORDER BY sidecar_no) AS place, sidecar_no, CASE WHEN length(citation) > 12 THEN left(citation, 11) || '…' ELSE citation END AS citation, CASE WHEN length(title) > 30 THEN left(title, 29) || '…' ELSE coalesce(title, '') END AS title FROM reference_sidecars WHERE kind = 'statute'""")
def q95_listing(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators import references

    return references.listing(table(spark, d, "reference_sidecars"), columns={"citation": 12, "title": 30}, kind="statute", order="sidecar_no")


@query("""
SELECT 'party' AS source, trim(display_name) AS name, coalesce(role, '') AS detail FROM entities WHERE list_contains(labels, 'insurer') AND trim(display_name) <> ''
UNION ALL SELECT 'reference', trim(title), coalesce(kind, '') FROM reference_sidecars WHERE trim(title) <> ''""")
def q96_cards(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators import references

    e = table(spark, d, "entities").where(F.array_contains("labels", "insurer")).select(F.col("display_name").alias("name"), F.col("role").alias("detail"))
    return references.cards(e, table(spark, d, "reference_sidecars").select(F.col("title").alias("name"), F.col("kind").alias("detail")), name="name", detail="detail")


@query(r"""
SELECT sidecar_no, regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS host, strlen(citation) AS size_bytes, sha256(citation) AS sha256 FROM reference_sidecars""")
def q97_fetched(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators import references

    r = table(spark, d, "reference_sidecars").select("sidecar_no", "source_url", "citation")
    return references.fetched(r, url="source_url", content="citation").select("sidecar_no", "host", "size_bytes", "sha256")

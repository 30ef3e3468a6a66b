"""Queries of the evidence operators, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import quality, rules, text, values
from docketry.operators import integrity, matching, pages, reports, scrub, threads, timeline
from docketry.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# integrity ---------------------------------------------------------------------------------------


def _manifest(spark, d):
    return integrity.hash_manifest(table(spark, d, "documents").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))), "path", "text")


@query("SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256, left(sha256(text), 16) AS source_id FROM documents")
def q01_hash_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d)


@query("""
WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 90 <> 0),
     k AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 70 <> 0)
SELECT CASE WHEN k.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'untracked' WHEN m.h = k.h THEN 'ok' ELSE 'hash-mismatch' END AS status, count(*) AS files
FROM m FULL OUTER JOIN k ON m.doc_id = k.doc_id GROUP BY 1""")
def q02_manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    m = docs.where(F.col("doc_id") % 90 != 0).select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    disk = docs.where(F.col("doc_id") % 70 != 0).select(F.col("doc_id").alias("path"), F.sha2(changed, 256).alias("sha256"))
    return integrity.verify_manifest(m, disk).groupBy("status").agg(F.count("*").alias("files"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def q03_source_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = integrity.one_per_key(docs, "sha256", "doc_id")
    return first.join(docs.groupBy("sha256").agg(F.count("*").alias("copies")), "sha256").select("sha256", "doc_id", "copies")


@query("""
WITH r AS (SELECT coalesce(source, '') AS widget, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 101 <> 0),
     c AS (SELECT coalesce(source, '') AS widget, doc_id, CASE WHEN doc_id % 97 = 0 AND source = 'letters' THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE NOT (doc_id % 101 = 0 AND source <> 'sms'))
SELECT coalesce(r.widget, c.widget) AS widget, bool_or(r.h IS DISTINCT FROM c.h) AS stale FROM r FULL OUTER JOIN c ON r.widget = c.widget AND r.doc_id = c.doc_id GROUP BY 1""")
def q04_cache_stale(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.coalesce("source", F.lit("")).alias("widget"), F.col("doc_id").alias("path"), F.sha2("text", 256).alias("h"))
    recorded = docs.where(F.col("path") % 101 != 0).select("widget", "path", F.col("h").alias("sha256"))
    now = docs.where(~((F.col("path") % 101 == 0) & (F.col("source") != "sms"))).select("widget", "path", F.when((F.col("path") % 97 == 0) & (F.col("source") == "letters"), F.lit("x")).otherwise(F.col("h")).alias("sha256"))
    return integrity.stale(recorded, now)


@query("""
SELECT event_id, user_id, CASE WHEN prev IS NULL THEN 'initial' WHEN blob IS NOT DISTINCT FROM prev THEN 'rename-or-metadata' ELSE 'content' END AS change_type
FROM (SELECT *, last_value(blob IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS blob FROM events))""")
def q05_change_trail(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("blob"))
    return integrity.change_trail(e, path="user_id", order=["ts", "event_id"], blob="blob").select("event_id", "user_id", "change_type")


# rules -------------------------------------------------------------------------------------------

KIND_RULES = [("**/emails/raw/*.eml", "email"), ("**/emails/**", "email_record"), ("**/voicemail/**/*.csv", "call_log"), ("**/photos/*.jp?g", "photo"), ("**/screenshots/*", "screenshot"), ("**/medical/eob_*", "benefit_statement"), ("**/*.md", "text_note"), ("**/*.pdf", "document")]
_KIND_SQL = r"""CASE WHEN regexp_full_match(p, '(.*/)?emails/raw/[^/]*\.eml') THEN 'email' WHEN regexp_full_match(p, '(.*/)?emails/.*') THEN 'email_record'
 WHEN regexp_full_match(p, '(.*/)?voicemail/(.*/)?[^/]*\.csv') THEN 'call_log' WHEN regexp_full_match(p, '(.*/)?photos/[^/]*\.jp[^/]g') THEN 'photo' WHEN regexp_full_match(p, '(.*/)?screenshots/[^/]*') THEN 'screenshot'
 WHEN regexp_full_match(p, '(.*/)?medical/eob_[^/]*') THEN 'benefit_statement' WHEN regexp_full_match(p, '(.*/)?[^/]*\.md') THEN 'text_note' WHEN regexp_full_match(p, '(.*/)?[^/]*\.pdf') THEN 'document' ELSE 'unknown' END"""


@query(f"SELECT entry_id, {_KIND_SQL} AS kind FROM (SELECT entry_id, lower(path) AS p FROM snapshot_entries)")
def q06_kind_inference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshot_entries").select("entry_id", rules.first_match(F.col("path"), KIND_RULES, "unknown").alias("kind"))


@query(f"""
WITH k AS (SELECT {_KIND_SQL} AS kind, NULL AS source_type FROM (SELECT lower(path) AS p FROM snapshot_entries) UNION ALL SELECT '' AS kind, method AS source_type FROM extraction_results)
SELECT coalesce(nullif(kind, ''), nullif(source_type, ''), 'unknown') AS kind, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM k""")
def q07_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    a = q06_kind_inference(spark, d).select("kind", F.lit(None).cast("string").alias("source_type"))
    b = table(spark, d, "extraction_results").select(F.lit("").alias("kind"), F.col("method").alias("source_type"))
    return reports.kind_counts(a.unionByName(b), ["kind", "source_type"])


DENY = [("*.sample-denied.example", "mirror"), ("*paste*", "paste")]
ALLOW = [("*.gov", "official"), ("*.gov.example", "official"), ("*law*", "reference"), ("*.example", "test")]


@query(r"""
SELECT sidecar_no, h AS host, CASE WHEN regexp_full_match(h, '.*\.sample-denied\.example') THEN 'deny:mirror' WHEN regexp_full_match(h, '.*paste.*') THEN 'deny:paste'
 WHEN regexp_full_match(h, '.*\.gov') THEN 'allow:official' WHEN regexp_full_match(h, '.*\.gov\.example') THEN 'allow:official' WHEN regexp_full_match(h, '.*law.*') THEN 'allow:reference' WHEN regexp_full_match(h, '.*\.example') THEN 'allow:test' ELSE 'unknown' END AS verdict
FROM (SELECT sidecar_no, regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS h FROM reference_sidecars)""")
def q08_host_policy(spark: SparkSession, d: str) -> DataFrame:
    h = text.host(F.col("source_url"))
    return table(spark, d, "reference_sidecars").select("sidecar_no", h.alias("host")).select("*", rules.host_verdict(F.col("host"), DENY, ALLOW).alias("verdict"))


@query(r"""
SELECT delivery_id FROM correspondence
WHERE list_has_any(regexp_extract_all(lower(from_addr || ' ' || coalesce(to_addr, '')), '@[a-z0-9.-]+'), ['@northmail.example', '@mailbarn.example'])
  AND regexp_matches(lower(subject), 'report|invoice') AND try_cast(date_iso AS DATE) BETWEEN DATE '2022-01-01' AND DATE '2024-12-31'""")
def q09_correspondence_filter(spark: SparkSession, d: str) -> DataFrame:
    cfg = {"parties": ["@northmail.example", "@mailbarn.example"], "subject": ["report|invoice"], "since": "2022-01-01", "until": "2024-12-31"}
    hdr = F.lower(F.concat_ws(" ", "from_addr", F.coalesce("to_addr", F.lit(""))))
    found = F.regexp_extract_all(hdr, F.lit(r"[a-z0-9._%+-]*@[a-z0-9.-]+"), F.lit(0))
    day = F.col("date_iso").try_cast("date")
    none = F.create_map().cast("map<string,string>")
    return table(spark, d, "correspondence").where(rules.message_predicate(cfg, addresses=found, subject=F.col("subject"), body=F.lit(""), headers=none, day=day)).select("delivery_id")


@query("""
SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE + CAST(o_orderkey % 400 AS INTEGER) WHEN 1 THEN o_orderdate::DATE + to_months(CAST(o_orderkey % 37 AS INTEGER)) ELSE o_orderdate::DATE + to_years(CAST(o_orderkey % 5 AS INTEGER)) END, '%Y-%m-%d') AS due FROM orders""")
def q10_add_duration(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    unit = F.when(k == 0, "days").when(k == 1, "months").otherwise("years")
    n = F.when(k == 0, F.col("o_orderkey") % 400).when(k == 1, F.col("o_orderkey") % 37).otherwise(F.col("o_orderkey") % 5).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(values.add_duration(F.col("o_orderdate").cast("date"), unit, n), "yyyy-MM-dd").alias("due"))


RULES = [("repair", ["repair", "bumper", "estimate"]), ("medical", ["clinic", "anesthesia", "physiotherapy"]), ("storage", ["storage", "towed", "yard"]), ("coverage", ["policy", "endorsement", "denial"])]
_SCORE = " + ".join


@query(
    "WITH s AS (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws) + f") AS {k}" for k, ws in RULES)
    + " FROM documents) SELECT doc_id, CASE WHEN greatest(repair, medical, storage, coverage) = 0 THEN 'unknown' WHEN repair >= greatest(medical, storage, coverage) THEN 'repair' WHEN medical >= greatest(storage, coverage) THEN 'medical' WHEN storage >= coverage THEN 'storage' ELSE 'coverage' END AS best, greatest(repair, medical, storage, coverage) AS score FROM s"
)
def q11_keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    return matching.keyword_scores(table(spark, d, "documents").select("doc_id", "text"), "text", RULES).select("doc_id", "best", "score")


@query("""
SELECT s_suppkey, 'state' AS scope, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey, 'federal', r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q12_lookup_union(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    r = F.broadcast(table(spark, d, "region"))
    state = s.select("s_suppkey", F.lit("state").alias("scope"), F.col("n_name").alias("name"))
    return state.unionByName(s.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.lit("federal").alias("scope"), F.col("r_name").alias("name")))


@query()
def q13_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    web = p.where(F.col("p_partkey") % 3 != 0).withColumn("p_name", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(" x")).otherwise(F.lit(""))))
    return matching.greedy_match(p, web, group=["p_brand", "p_type", "p_size"], name="p_name", order="p_partkey")


# text quality ------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS toks FROM documents)
SELECT doc_id, length(text) AS chars, len(toks) AS n_tokens, round(len(list_filter(toks, lambda x: regexp_matches(x, '[A-Za-z]{2,}'))) / greatest(len(toks), 1), 6) AS word_shape FROM t""")
def q14_word_shape(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(c).alias("chars"), F.size(quality.tokens(c)).alias("n_tokens"), F.round(quality.word_shape(c), 6).alias("word_shape"))


@query(r"""
WITH p AS (SELECT page_id, coalesce(text, '') AS t FROM page_results),
 k AS (SELECT page_id, t, length(t) AS n, list_filter(string_split_regex(t, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS toks,
   list_filter(list_transform(list_filter(string_split_regex(nfc_normalize(t), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''),
     lambda x: regexp_replace(x, '^[!-/:-@\[-`{-~“”‘’–—…«»]+|[!-/:-@\[-`{-~“”‘’–—…«»]+$', '', 'g')), lambda x: regexp_matches(x, '\pL')) AS words FROM p),
 r AS (SELECT page_id, n, list_sum(list_transform(regexp_extract_all(t, '\(cid:\d+\)'), lambda x: length(x))) / greatest(n, 1) AS cid, length(regexp_replace(t, '[^\x{FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]', '', 'g')) / greatest(n, 1) AS bad,
   len(toks) AS nt, CASE WHEN len(toks) > 0 THEN len(list_filter(toks, lambda x: regexp_matches(x, '[A-Za-z]{2,}'))) / len(toks) ELSE 0.0 END AS shape,
   CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: NOT regexp_matches(regexp_replace(x, '[A-Za-z]', '', 'g'), '\pL'))) / len(words) ELSE 1.0 END AS eng FROM k),
 z AS (SELECT page_id, n, coalesce(cid, 0) AS cid, bad, shape, eng, CASE WHEN n = 0 THEN 'empty extraction' ELSE concat_ws('; ', CASE WHEN coalesce(cid, 0) > 0.02 THEN 'cid-glyph ratio' END, CASE WHEN bad > 0.05 THEN 'non-printable ratio' END,
   CASE WHEN nt > 0 AND shape < 0.4 THEN 'word-shape ratio' END, CASE WHEN eng < 0.85 THEN 'english-token ratio' END, CASE WHEN n < 50 THEN 'chars/page' END) END AS reasons FROM r)
SELECT page_id, n AS chars, round(cid, 6) AS cid_ratio, round(bad, 6) AS nonprintable_ratio, round(shape, 6) AS word_shape_ratio, round(eng, 6) AS english_ratio, reasons <> '' AS garbled, reasons FROM z""")
def q14_garble_score(spark: SparkSession, d: str) -> DataFrame:
    scored = quality.with_garble(table(spark, d, "page_results").select("page_id", "text"), "text", page=True)
    return scored.select("page_id", "chars", F.round("cid_ratio", 6).alias("cid_ratio"), F.round("nonprintable_ratio", 6).alias("nonprintable_ratio"), F.round("word_shape_ratio", 6).alias("word_shape_ratio"), F.round("english_ratio", 6).alias("english_ratio"), "garbled", "reasons")


@query(r"""
WITH p AS (SELECT extraction_id, page_number, min(text) AS text FROM page_results GROUP BY ALL),
 t AS (SELECT extraction_id AS e, page_number AS n, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS toks FROM p),
 c AS (SELECT e, n, w, count(*) AS k FROM (SELECT e, n, unnest(toks) AS w FROM t) GROUP BY ALL),
 o AS (SELECT a.e, a.n, sum(least(a.k, b.k)) AS common FROM c a JOIN c b ON a.e = b.e AND b.n = a.n + 1 AND a.w = b.w GROUP BY ALL)
SELECT x.e AS extraction_id, x.n AS page_number, round(CASE WHEN len(x.toks) + len(y.toks) = 0 THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (len(x.toks) + len(y.toks)) END, 6) AS f1
FROM t x JOIN t y ON x.e = y.e AND y.n = x.n + 1 LEFT JOIN o ON o.e = x.e AND o.n = x.n""")
def q15_token_f1(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").groupBy("extraction_id", "page_number").agg(F.min("text").alias("text"))
    nxt = p.select("extraction_id", (F.col("page_number") - 1).alias("page_number"), F.col("text").alias("other"))
    return p.join(nxt, ["extraction_id", "page_number"]).select("extraction_id", "page_number", F.round(quality.token_f1(F.col("text"), F.col("other")), 6).alias("f1"))


@query(r"""
WITH a AS (SELECT page_id, text AS p, CASE WHEN page_id % 3 = 0 THEN regexp_replace(text, '(\S+)\s+(\S+)\s+', '\1 ', 'g') ELSE text END AS s FROM page_results WHERE page_id % 11 <> 0),
 t AS (SELECT page_id, list_filter(string_split_regex(p, '\s+'), lambda x: x <> '') AS x, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS y FROM a),
 c AS (SELECT page_id, w, count(*) FILTER (side = 0) AS k0, count(*) FILTER (side = 1) AS k1 FROM (SELECT page_id, unnest(x) AS w, 0 AS side FROM t UNION ALL SELECT page_id, unnest(y), 1 FROM t) GROUP BY ALL),
 o AS (SELECT page_id, sum(least(k0, k1)) AS common FROM c GROUP BY 1)
SELECT p.page_id, round(CASE WHEN t.page_id IS NULL THEN NULL WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (len(x) + len(y)) END, 6) AS agreement,
 coalesce(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (len(x) + len(y)) END < 0.85, false) AS disagrees,
 CASE WHEN coalesce(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (len(x) + len(y)) END < 0.85, false) AND q.s > q.p THEN 'shadow' ELSE 'primary' END AS chosen
FROM page_results p LEFT JOIN t ON t.page_id = p.page_id LEFT JOIN o ON o.page_id = p.page_id LEFT JOIN (
 SELECT page_id, CASE WHEN len(px) = 0 THEN 0.0 ELSE len(list_filter(px, lambda w: regexp_matches(w, '[A-Za-z]{2,}'))) / len(px) + CASE WHEN len(pw) = 0 THEN 1.0 ELSE len(list_filter(pw, lambda w: NOT regexp_matches(regexp_replace(w, '[A-Za-z]', '', 'g'), '\pL'))) / len(pw) END END AS p,
  CASE WHEN len(sx) = 0 THEN 0.0 ELSE len(list_filter(sx, lambda w: regexp_matches(w, '[A-Za-z]{2,}'))) / len(sx) + CASE WHEN len(sw) = 0 THEN 1.0 ELSE len(list_filter(sw, lambda w: NOT regexp_matches(regexp_replace(w, '[A-Za-z]', '', 'g'), '\pL'))) / len(sw) END END AS s
 FROM (SELECT page_id, px, sx, list_filter(px, lambda w: regexp_matches(w, '\pL')) AS pw, list_filter(sx, lambda w: regexp_matches(w, '\pL')) AS sw FROM (
  SELECT page_id, list_filter(string_split_regex(p, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '') AS px, list_filter(string_split_regex(s, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '') AS sx FROM a))) q ON q.page_id = p.page_id""")
def q16_reconcile_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("page_id", "text")
    thinned = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("text", r"(\S+)\s+(\S+)\s+", "$1 ")).otherwise(F.col("text"))
    shadow = p.where(F.col("page_id") % 11 != 0).select("page_id", thinned.alias("text"))
    return pages.reconcile_pages(p, shadow, keys=["page_id"]).select("page_id", F.round("agreement", 6).alias("agreement"), "disagrees", "chosen")


@query("""
WITH m AS (SELECT extraction_id, page_id, page_number, CASE WHEN garbled AND page_id % 2 = 0 AND length(text) > 0 THEN 'clean ' || page_id ELSE text END AS text, garbled AND page_id % 2 = 0 AND length(text) > 0 AS merged FROM page_results)
SELECT extraction_id, string_agg(trim(text, E' \\t\\n\\r'), E'\\n\\n' ORDER BY page_number, trim(text, E' \\t\\n\\r')) FILTER (trim(text, E' \\t\\n\\r') <> '') AS text, count(*) AS n_pages FROM m GROUP BY 1""")
def q17_page_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("extraction_id", "page_id", "page_number", "text", "garbled")
    other = p.select("page_id", F.when((F.col("page_id") % 2 == 0) & (F.length("text") > 0), F.concat(F.lit("clean "), F.col("page_id").cast("string"))).otherwise(F.lit("")).alias("text"), F.lit(False).alias("garbled"))
    merged = pages.merge_pages(p, other, keys=["page_id"])
    done = pages.document_text(merged, doc="extraction_id", number="page_number")
    return done.select("extraction_id", F.nullif("text", F.lit("")).alias("text"), "n_pages")


@query(r"""
WITH s AS (SELECT doc_id, kind, text, regexp_replace(text, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS t FROM documents),
 f AS (SELECT doc_id, t = '' AS empty, [CASE WHEN length(t) < CASE WHEN kind = 'reference' THEN 400 ELSE 0 END THEN 'short-for-kind' END, CASE WHEN NOT regexp_matches(right(t, 1), '[.!?"'')\]]') THEN 'truncation-suspected' END,
  CASE WHEN contains(text, '[truncated]') OR contains(text, '[...]') OR contains(text, '(continued on next page)') OR contains(text, '* * *') OR contains(text, '...') THEN 'has-truncation-marker' END,
  CASE WHEN regexp_matches(left(t, 500), '(?i)\b(excerpt|partial|sample|preview)\b') THEN 'looks-like-excerpt' END, CASE WHEN contains(text, chr(65533)) OR regexp_matches(text, '(?i)\\ufffd') THEN 'encoding-issues' END,
  CASE WHEN kind = 'reference' AND NOT regexp_matches(text, '(?im)(§\s*\d|\bsection\s+\d|\b\d+(\.\d+)+\b|^\s*\([a-z0-9]+\)\s+\w|^\s*\d+\.\s+\w)') THEN 'no-section-numbers' END] AS warn,
  [CASE WHEN regexp_matches(text, '\b(DRAFT|CONFIDENTIAL|DO NOT DISTRIBUTE|FOR INTERNAL USE)\b') THEN 'has-watermark' END,
  CASE WHEN NOT regexp_matches(text, '(?i)(\b(effective\s+(date|as\s+of|on)|as\s+of\s+\d{4}|last\s+(updated|revised|amended)|version\s+\d)\b|©\s*\d{4}\b)') THEN 'no-effective-date' END] AS info FROM s)
SELECT doc_id, CASE WHEN empty THEN 'empty' ELSE array_to_string(list_filter(list_concat(warn, info), lambda x: x IS NOT NULL), ',') END AS flags, NOT empty AND len(list_filter(warn, lambda x: x IS NOT NULL)) = 0 AS appears_complete FROM f""")
def q18_assess(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "reference", "statute").otherwise("other")
    done = quality.with_assessment(table(spark, d, "documents").select("doc_id", "kind", "text"), "text", kind)
    return done.select("doc_id", "flags", "appears_complete")


@query("SELECT doc_id, kind AS title, 'utf-8' AS charset, length('- ' || kind || E'\\n- ' || coalesce(lang, 'none') || E'\\n') AS n FROM documents")
def q19_html_render(spark: SparkSession, d: str) -> DataFrame:
    from docketry.functions.html import rendered

    page = F.concat(F.lit("<html><head><title>"), F.col("kind"), F.lit("</title><style>p{}</style></head><body><script>x</script><ul><li> "), F.col("kind"), F.lit("</li><li>"), F.coalesce("lang", F.lit("none")), F.lit("</li></ul></body></html>"))
    df = table(spark, d, "documents").select("doc_id", rendered(page.cast("binary")).alias("r"))
    return df.select("doc_id", "r.title", "r.charset", F.length(F.regexp_replace("r.text", "\n\n", "\n")).alias("n"))


@query("SELECT extraction_id, coalesce(length(text), 0) < 200 AND 8 * coalesce(length(title), 0) / greatest(1, coalesce(length(text), 0)) > 10.0 OR (coalesce(length(text), 0) < 200 AND coalesce(length(title), 0) = 0) AS is_empty FROM extraction_results")
def q20_html_empty(spark: SparkSession, d: str) -> DataFrame:
    n, raw = F.coalesce(F.length("text"), F.lit(0)), 8 * F.coalesce(F.length("title"), F.lit(0))
    return table(spark, d, "extraction_results").select("extraction_id", quality.html_is_empty(n, raw).alias("is_empty"))


# scrubbing ---------------------------------------------------------------------------------------

TERMS = {"Verrid Indemnity": "[CARRIER]", "Verrid": "[V]", "Garage Lévêque": "[SHOP]"}


@query(r"""
SELECT extraction_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails,
 CAST((length(text) - length(replace(text, 'Verrid Indemnity', ''))) / 16 AS BIGINT) AS carriers FROM extraction_results WHERE text IS NOT NULL""")
def q21_scrub_counts(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "extraction_results").where(F.col("text").isNotNull()).select("extraction_id", "text")
    done = scrub.scrub(src, "text", mapping=TERMS)
    count = lambda c: F.size(F.filter("changes", c)).cast("bigint")
    return done.select("extraction_id", count(lambda c: c["detector"] == "email").alias("emails"), count(lambda c: c["replacement"] == "[CARRIER]").alias("carriers"))


@query()
def q22_scrub_report(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "call_log").where(F.col("transcript").isNotNull()).select("call_id", "transcript")
    return scrub.scrub_report(scrub.scrub(src, "transcript", mapping=TERMS, policies=[r"\b[Qq][Pp]-\d{3,4}-\d{3,4}\b"]), "call_id")


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'Verrid Indemnity') THEN 'Verrid Indemnity' END, CASE WHEN contains(text, 'Garage Lévêque') THEN 'Garage Lévêque' END, CASE WHEN contains(text, 'hatchback') THEN 'hatchback' END) AS terms
FROM documents WHERE contains(text, 'Verrid Indemnity') OR contains(text, 'Garage Lévêque') OR contains(text, 'hatchback')""")
def q23_banned_survivors(spark: SparkSession, d: str) -> DataFrame:
    left = scrub.survivors(F.col("text"), scrub.banned_terms({"Verrid Indemnity": "x", "Garage Lévêque": "x"}, ["hatchback"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(left, ",").alias("terms")).where(F.col("terms") != "")


# threads and timeline ----------------------------------------------------------------------------


@query(r"""
WITH c AS (SELECT delivery_id, delivered_at, from_addr, case_id || '|' || trim(regexp_replace(lower(coalesce(subject, '')), '^(\s*(re|fwd?|aw)\s*:\s*)+', '')) AS root FROM correspondence)
SELECT root AS root_id, arg_min(delivery_id, (delivered_at, delivery_id)) AS first_id, arg_max(delivery_id, (delivered_at, delivery_id)) AS last_id, count(*) AS n_comments, arg_max(from_addr, (delivered_at, delivery_id)) AS last_author FROM c GROUP BY 1""")
def q24_thread_catalog(spark: SparkSession, d: str) -> DataFrame:
    root = F.concat("case_id", F.lit("|"), threads.message_root(F.col("subject")))
    c = table(spark, d, "correspondence").select("delivery_id", "delivered_at", "from_addr", "subject", root.alias("root"))
    done = threads.thread_catalog(c, root="root", order=["delivered_at", "delivery_id"], author="from_addr", text="subject", me="")
    return done.select("root_id", "first_id", "last_id", "n_comments", "last_author")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_custkey - 1 END AS up FROM customer),
 r AS (SELECT node, node AS root FROM e WHERE up IS NULL OR up NOT IN (SELECT node FROM e) UNION ALL SELECT e.node, r.root FROM e JOIN r ON e.up = r.node)
SELECT node, CASE WHEN root % 10 = 1 THEN root ELSE root - 1 END AS root FROM r""")
def q25_thread_roots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 10 != 1, F.col("c_custkey") - 1).alias("up"))
    return threads.thread_roots(e, node="node", parent="up")


@query(r"""
WITH m AS (SELECT delivery_id, case_id, lower(concat_ws(' ', coalesce(from_addr, ''), coalesce(to_addr, ''), coalesce(subject, ''))) AS hay FROM correspondence),
 x AS (SELECT delivery_id, case_id, hay, regexp_extract_all(hay, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS mails FROM m)
SELECT delivery_id, entity_no FROM x JOIN entities e ON x.case_id = e.case_id
WHERE list_has_any(mails, list_transform(coalesce(match_emails, []), lambda q: lower(q))) OR len(list_filter(match_names, lambda q: q <> '' AND contains(hay, lower(q)))) > 0""")
def q26_tag_entities(spark: SparkSession, d: str) -> DataFrame:
    return timeline.tag_entities(table(spark, d, "correspondence"), table(spark, d, "entities"), key="delivery_id", case="case_id", hay=["from_addr", "to_addr", "subject"], entity="entity_no", emails="match_emails", names="match_names")


@query(r"""
SELECT strftime(ts, '%Y-%m-%d') AS marker_date, 'event' AS kind, 'events' AS source, event_type AS title, CAST(NULL AS VARCHAR) AS summary, CAST(event_id AS VARCHAR) AS ref_id, 'neutral_event' AS track FROM events
UNION ALL SELECT left(trim(date_iso), 10), 'correspondence', 'correspondence', coalesce(nullif(trim(subject), ''), '(no subject)'),
 nullif(concat_ws(' · ', CASE WHEN coalesce(trim(from_addr), '') <> '' THEN 'from: ' || trim(from_addr) END, CASE WHEN coalesce(trim(to_addr), '') <> '' THEN 'to: ' || trim(to_addr) END), ''), CAST(delivery_id AS VARCHAR), 'correspondence'
 FROM correspondence WHERE regexp_full_match(left(trim(date_iso), 10), '\d{4}-\d{2}-\d{2}') AND try_cast(left(trim(date_iso), 10) AS DATE) IS NOT NULL
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), 'deadline', 'deadlines', '[DEADLINE] ' || o_orderpriority || CASE WHEN o_orderstatus = '' THEN '' ELSE ' (' || o_orderstatus || ')' END, NULL, CAST(o_orderkey AS VARCHAR), 'deadline' FROM orders""")
def q27_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("event_id").alias("ref_id"), F.lit("neutral_event").alias("track"))
    m = table(spark, d, "correspondence").select(F.col("date_iso").alias("date"), "subject", "from_addr", "to_addr", F.col("delivery_id").alias("ref_id"), F.lit("correspondence").alias("track"))
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("string").alias("notes"), F.col("o_orderkey").alias("ref_id"), F.col("o_orderstatus").alias("status"))
    return timeline.union_timeline(e, m, o)


@query("SELECT unnest(entity_ids) AS entity_id, marker_id, marker_date, kind, title, track FROM timeline_markers")
def q28_entity_drilldown(spark: SparkSession, d: str) -> DataFrame:
    return timeline.entity_markers(table(spark, d, "timeline_markers"), "entity_ids", ["marker_id", "marker_date", "kind", "title", "track"])


@query("""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY marker_date NULLS FIRST, kind, title, marker_id) - 1 AS i FROM timeline_markers)
SELECT marker_id, track, i AS idx FROM ranked""")
def q28_track_index(spark: SparkSession, d: str) -> DataFrame:
    from docketry.runtime import rank_in_group

    m = table(spark, d, "timeline_markers").select("marker_id", "track", "marker_date", "kind", "title")
    return rank_in_group(m, ["track"], ["marker_date", "kind", "title", "marker_id"], "n").select("marker_id", "track", (F.col("n") - 1).alias("idx"))


# values ------------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS billed, count(*) AS lines, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_day, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_day FROM lineitem GROUP BY 1""")
def q29_money_dates(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))
    pick = F.col("l_linenumber") % 3
    day = F.when(pick == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(pick == 1, F.date_format("l_shipdate", "M/d/yyyy")).otherwise(F.date_format("l_shipdate", "MM/dd/yy"))
    lines = table(spark, d, "lineitem").select("l_returnflag", values.money(shown).alias("billed"), values.day_or_text(day).alias("day"))
    return lines.groupBy("l_returnflag").agg(F.sum("billed").cast("double").alias("billed"), F.count("*").alias("lines"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN epoch_us(ts) // 1000 ELSE (epoch_us(ts) // 1000000) * 1000 END AS ms FROM events")
def q30_epoch_parse(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 3 == 0, F.unix_seconds(ts).cast("string")).when(F.col("event_id") % 3 == 1, F.unix_millis(ts).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.unix_millis(values.epoch_or_iso(raw)).alias("ms"))


@query(r"""
SELECT p_partkey, left(coalesce(nullif(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'msg'), 40) AS slug,
 regexp_replace(left(regexp_replace(regexp_replace(lower(p_brand || '#' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS citation, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS name_key,
 CASE WHEN p_partkey % 700 < 26 THEN chr(CAST(65 + p_partkey % 700 AS INTEGER)) ELSE chr(CAST(64 + (p_partkey % 700) // 26 AS INTEGER)) || chr(CAST(65 + (p_partkey % 700) % 26 AS INTEGER)) END AS label FROM part""")
def q31_slugs_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), text.citation_slug(F.concat_ws("#", "p_brand", "p_name")).alias("citation"), text.name_key(F.col("p_type")).alias("name_key"), text.label(F.col("p_partkey") % 700).alias("label"))


@query("""
SELECT CASE WHEN doc_id % 90 = 0 THEN 'warn' WHEN doc_id % 50 = 0 THEN 'fail' WHEN doc_id % 70 = 0 THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS files FROM documents GROUP BY 1""")
def q32_bundle_verdict(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    warnings = F.filter(F.array(F.when(n % 90 == 0, F.lit("content changed 2 times")), F.when(n % 50 == 0, F.lit("HASH MISMATCH")), F.when(n % 70 == 0, F.lit("not in manifest"))), lambda w: w.isNotNull())
    return table(spark, d, "documents").select(integrity.verdict(warnings).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("files"))


@query("""
SELECT a.entry_id, count(b.entry_id) AS seen FROM snapshot_entries a JOIN snapshot_entries b ON a.case_id = b.case_id AND regexp_extract(a.path, '[^/]+$') = regexp_extract(b.path, '[^/]+$') AND b.snapshot_no < a.snapshot_no GROUP BY 1""")
def q33_basename_history(spark: SparkSession, d: str) -> DataFrame:
    return reports.basename_history(table(spark, d, "snapshot_entries"), scope="case_id", path="path", number="snapshot_no", key="entry_id")


@query("""
SELECT extraction_id, count(*) FILTER (garbled) AS garbled_pages, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (garbled), '') AS page_list, bool_or(garbled) AS any_garbled, bool_or(trim(text, E' \\t\\n\\r') <> '') AS has_text FROM page_results GROUP BY 1""")
def q34_garbled_pages(spark: SparkSession, d: str) -> DataFrame:
    return reports.garbled_pages(table(spark, d, "page_results"), doc="extraction_id")


@query(r"""
SELECT marker_id, CASE WHEN regexp_full_match(left(trim(marker_date), 10), '\d{4}-\d{2}-\d{2}') AND try_cast(left(trim(marker_date), 10) AS DATE) IS NOT NULL THEN left(trim(marker_date), 10) END AS day FROM timeline_markers""")
def q35_marker_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "timeline_markers").select("marker_id", values.iso_prefix(F.col("marker_date")).alias("day"))


@query("""
SELECT call_id, CASE WHEN lower(trim(direction)) IN ('incoming', 'outgoing', 'missed', 'voicemail') THEN lower(trim(direction)) WHEN nullif(trim(direction), '') IS NOT NULL THEN 'unknown:' || lower(trim(direction)) END AS direction FROM call_log""")
def q36_call_direction(spark: SparkSession, d: str) -> DataFrame:
    from docketry.sources.files import call_rows

    calls = table(spark, d, "call_log")
    rows = calls.select(F.col("call_id").cast("string").alias("transcript"), "direction", F.lit(None).cast("string").alias("timestamp"), F.lit("1").alias("duration_seconds"))
    return call_rows(rows).select(F.col("transcript").cast("bigint").alias("call_id"), "direction")


@query("""
SELECT entity_no, role IS NULL OR role NOT IN ('neutral', 'adversary', 'ally', 'self') AS bad_role, NOT regexp_full_match(entity_id, '[a-z0-9][a-z0-9_-]*') AS bad_id, count(*) OVER (PARTITION BY entity_id) > 1 AS repeated_id FROM entities""")
def q37_entity_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities")
    n = e.groupBy("entity_id").agg((F.count("*") > 1).alias("repeated_id"))
    bad = ~F.coalesce(F.col("role").isin("neutral", "adversary", "ally", "self"), F.lit(False))
    return e.join(n, "entity_id").select("entity_no", bad.alias("bad_role"), (~F.col("entity_id").rlike(r"^[a-z0-9][a-z0-9_-]*\z")).alias("bad_id"), "repeated_id")


@query("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def q38_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    from docketry.streaming.ingest import daily_counts

    return daily_counts(table(spark, d, "events")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


# lookups -----------------------------------------------------------------------------------------


@query(r"""
SELECT entry_id, regexp_replace(regexp_replace(path, '^((?:[^/]*/)*?)(?:raw|readable|structured|human)(/|$)', '\1structured\2'), '\.[^./]*$', '.json') AS sibling,
 path = 'evidence/emails' OR starts_with(path, 'evidence/emails/') AS protected FROM snapshot_entries""")
def q39_sibling_paths(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import sibling, under

    p = F.col("path")
    return table(spark, d, "snapshot_entries").select("entry_id", sibling(p, "structured", ".json").alias("sibling"), under(p, ["evidence/emails/"]).alias("protected"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'closed' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'O' THEN 'open' ELSE 'other' END AS role FROM lineitem""")
def q40_role_lookup(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import role_of

    rules_ = [{"author": "A", "initials": "F", "role": "closed"}, {"role": "never"}, {"author": "R", "role": "returned"}, {"initials": "O", "role": "open"}]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", role_of(F.col("l_returnflag"), F.col("l_linestatus"), rules_, "other").alias("role"))


@query("""
WITH dir AS (SELECT p_brand AS brand, p_type AS kind, min(p_partkey) AS part FROM part WHERE p_size > 25 GROUP BY ALL), every AS (SELECT p_brand AS brand, min(p_partkey) AS part FROM part GROUP BY 1)
SELECT p_partkey, coalesce(dir.part, every.part) AS part FROM part LEFT JOIN dir ON dir.brand = p_brand AND dir.kind = p_type LEFT JOIN every ON every.brand = p_brand""")
def q41_wildcard_directory(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import with_fallback

    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "p_size")
    exact = p.where(F.col("p_size") > 25).groupBy("brand", "kind").agg(F.min("p_partkey").alias("part"))
    every = p.groupBy("brand").agg(F.min("p_partkey").alias("part")).select("brand", F.lit("*").alias("kind"), "part")
    return with_fallback(p, exact.unionByName(every), on="brand", scope="kind", value="part").select("p_partkey", "part")


@query(r"""
WITH s AS (SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS s0 FROM documents), t AS (SELECT doc_id, coalesce(nullif(regexp_replace(s0, '-+$', ''), ''), 'ref') AS slug FROM s)
SELECT doc_id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS n FROM t)""")
def q42_unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import unique_slugs

    docs = table(spark, d, "documents").select("doc_id", text.citation_slug(F.col("text")).alias("slug"))
    return unique_slugs(docs, "slug", ["doc_id"]).select("doc_id", "unique_slug")


@query("SELECT delivery_id, CASE WHEN lower(trim(s)) IN ('emails', 'letters') THEN lower(trim(s)) WHEN s = '' THEN s WHEN starts_with(lower(trim(s)), 'emails') OR starts_with('emails', lower(trim(s))) THEN 'emails' WHEN starts_with(lower(trim(s)), 'letters') OR starts_with('letters', lower(trim(s))) THEN 'letters' ELSE s END AS kind FROM (SELECT delivery_id, left('Emails folder', CAST(delivery_id % 14 AS INTEGER)) AS s FROM correspondence)")
def q43_fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import fuzzy_name

    s = F.left(F.lit("Emails folder"), (F.col("delivery_id") % 14).cast("int"))
    return table(spark, d, "correspondence").select("delivery_id", fuzzy_name(s, ["emails", "letters"]).alias("kind"))


@query("SELECT extraction_id, source_type, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n FROM (SELECT DISTINCT extraction_id % 20 AS extraction_id, method AS source_type, path FROM extraction_results) GROUP BY ALL")
def q44_recorded_inputs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "extraction_results").select((F.col("extraction_id") % 20).alias("extraction_id"), F.col("method").alias("source_type"), "path")
    return reports.recorded_inputs(r, widget=["extraction_id", "source_type"])


@query("""
SELECT a.delivery_id AS left_id, b.delivery_id AS right_id, concat_ws(',', CASE WHEN a.subject <> '' AND b.subject <> '' AND a.subject <> b.subject THEN 'subject' END, CASE WHEN a.from_addr <> '' AND b.from_addr <> '' AND a.from_addr <> b.from_addr THEN 'from_addr' END, CASE WHEN a.to_addr <> '' AND b.to_addr <> '' AND a.to_addr <> b.to_addr THEN 'to_addr' END) AS fields
FROM correspondence a JOIN correspondence b ON b.delivery_id = a.delivery_id + 1""")
def q45_conflict_fields(spark: SparkSession, d: str) -> DataFrame:
    from docketry.operators.lookups import conflicts

    c, fields = table(spark, d, "correspondence"), ["subject", "from_addr", "to_addr"]
    left = c.select(F.col("delivery_id").alias("left_id"), (F.col("delivery_id") + 1).alias("right_id"), *[F.col(f).alias("local_" + f) for f in fields])
    right = c.select(F.col("delivery_id").alias("right_id"), *[F.col(f).alias("web_" + f) for f in fields])
    pairs = left.join(right, "right_id")
    return pairs.select("left_id", "right_id", conflicts(pairs, fields).alias("fields"))

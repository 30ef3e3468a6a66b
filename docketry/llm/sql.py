"""SQL that the queries on texts are checked against.

What the operators decide has no SQL; what must hold whatever they decide has: that nothing is lost,
repeated, overfull or out of bounds.
"""

SQL: dict[str, str] = {
    "p4_whole": """SELECT 'call_log' AS src, count(*) AS texts, count(DISTINCT call_id) AS rows_ FROM call_log WHERE transcript <> ''
UNION ALL SELECT 'extraction_results', count(*), count(DISTINCT extraction_id) FROM extraction_results WHERE text <> '' AND regexp_matches(lower(method), 'email|html')""",
    "p6_whole": "SELECT case_id, count(*) AS rows_, count(DISTINCT entity_no) AS entities, CAST(0 AS BIGINT) AS headless FROM entities WHERE case_id IS NOT NULL AND entity_no IS NOT NULL GROUP BY 1",
    "p7_whole": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS incomplete FROM containers WHERE container_kind IS NOT NULL AND capacity_tokens > 0",
    "p8_whole": "SELECT mix_id, count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unplaced, CAST(0 AS BIGINT) AS off FROM documents JOIN mix_targets USING (source) GROUP BY 1",
    "p9_whole": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids, count(DISTINCT coalesce(text, '')) AS texts, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, ''))) AS most_copies FROM documents",
}

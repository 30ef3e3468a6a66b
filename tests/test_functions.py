import hashlib

from pyspark.sql import functions as F

from docketry.functions import html, mail, metadata, quality, rules, text, values
from docketry.operators import integrity, matching, pages, scrub, threads, timeline


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_globs(spark):
    assert one(spark, "a/b/README.md", lambda c: rules.first_match(c, [("**/*.md", "note"), ("**/README*", "readme")], "unknown")) == "note"
    assert one(spark, "x.PDF", lambda c: rules.first_match(c, [("*.pdf", "pdf")], "unknown")) == "pdf"
    assert one(spark, "a/x.pdf", lambda c: rules.first_match(c, [("*.pdf", "pdf")], "unknown")) == "unknown"
    assert one(spark, "a/x.pdf", lambda c: rules.first_match(c, [("*.pdf", "pdf")], "unknown", cross=True)) == "pdf"
    assert one(spark, "a.bad.example", lambda c: rules.host_verdict(c, [("*.bad.example", "mirror")], [("*.example", "ok")])) == "deny:mirror"


def test_values(spark):
    assert one(spark, "$2,100.00", lambda c: values.money(c).cast("string")) == "2100.00" and one(spark, "n/a", values.money) is None
    assert [one(spark, v, values.day_or_text) for v in ("2024-03-01", "3/1/2024", "01/02/75", "03-01-2024", "soon")] == ["2024-03-01", "2024-03-01", "1975-01-02", "2024-03-01", "soon"]
    assert [one(spark, v, values.iso_prefix) for v in ("2024-03-01T10", "2024-13-01", "", None)] == ["2024-03-01", None, None, None]
    add = lambda d, u, n: str(spark.sql(f"select date'{d}' d").select(values.add_duration(F.col("d"), F.lit(u), F.lit(n)).alias("r")).first().r)
    assert [add("2025-03-15", "years", 3), add("2024-02-29", "years", 1), add("2025-01-31", "months", 1), add("2024-01-31", "months", 1), add("2025-03-15", "days", 60)] == ["2028-03-15", "2025-02-28", "2025-02-28", "2024-02-29", "2025-05-14"]
    assert one(spark, "1700000000000", lambda c: F.unix_seconds(values.epoch_or_iso(c))) == 1700000000 == one(spark, "1700000000", lambda c: F.unix_seconds(values.epoch_or_iso(c)))


def test_slugs_and_tags(spark):
    assert one(spark, " Re: Hello, World! ", text.slug) == "Re-Hello-World" and one(spark, "???", text.slug) == "msg"
    assert one(spark, "§ 27-303 (b)", text.citation_slug) == "27-303-b"
    assert [one(spark, i, text.label, "int") for i in (0, 25, 26, 701)] == ["A", "Z", "AA", "ZZ"]
    assert one(spark, "q+f: details", lambda c: F.struct(*text.tag(c))) == ("F+Q", "details")
    assert one(spark, "https://WWW.Example.com/x", text.host) == "example.com" and one(spark, "no url", text.host) is None


def test_garble(spark):
    para = "The adjuster inspected the vehicle and wrote a long report about the damage. " * 4
    rows = [("ok", para), ("empty", ""), ("none", None), ("short", "too short"), ("cid", "(cid:12)" * 30 + para), ("bad", "�" * 40 + para), ("greek", "Τhе аdjustеr inѕресtеd " * 10), ("num", "12345 67890 " * 30)]
    got = {r.k: r for r in quality.with_garble(spark.createDataFrame(rows, "k string, text string"), "text", page=True).collect()}
    assert not got["ok"].garbled and got["empty"].reasons == got["none"].reasons == "empty extraction"
    assert got["short"].reasons == "chars/page" and "cid-glyph" in got["cid"].reasons and "non-printable" in got["bad"].reasons and "english-token" in got["greek"].reasons
    assert "word-shape" in got["num"].reasons and got["num"].english_ratio == 1.0
    assert quality.f1("", None) == 1.0 and quality.f1("a", "") == 0.0 and quality.f1("a a b", "a b b") == quality.f1("a b b", "a a b") == 2 / 3


def test_pages(spark):
    base = spark.createDataFrame([(1, 1, "x", True), (1, 2, " fine ", False), (1, 3, "bad", True), (1, 4, "", False)], "d int, n int, text string, garbled boolean")
    other = spark.createDataFrame([(1, 1, "clean", False), (1, 2, "ignored", False), (1, 3, " ", False)], "d int, n int, text string, garbled boolean")
    merged = pages.merge_pages(base, other, keys=["d", "n"])
    assert [(r.n, r.text, r.garbled) for r in merged.orderBy("n").collect()] == [(1, "clean", False), (2, " fine ", False), (3, "bad", True), (4, "", False)]
    assert pages.document_text(merged, doc="d", number="n").first().text == "clean\n\nfine\n\nbad"
    r = pages.reconcile_pages(base, spark.createDataFrame([(1, 1, "entirely other words")], "d int, n int, text string"), keys=["d", "n"]).orderBy("n").collect()
    assert r[0].chosen == "shadow" and r[1].agreement is None and r[1].chosen == "primary"


def test_manifest(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, sha256 string")
    d = spark.createDataFrame([("a", "1"), ("b", "3"), ("x", "4"), ("c", None)], "path string, sha256 string")
    assert {(r.path, r.status) for r in integrity.verify_manifest(m, d).collect()} == {("a", "ok"), ("b", "hash-mismatch"), ("x", "untracked"), ("c", "ok")}
    assert integrity.verify_manifest(m, m).where("status <> 'ok'").count() == 0
    out, conflicts = integrity.append_entries(m.withColumnRenamed("path", "source_id"), spark.createDataFrame([("a", "9"), ("z", "8")], "source_id string, sha256 string"), force=True)
    assert conflicts.count() == 1 and {(r.source_id, r.sha256) for r in out.collect()} == {("a", "9"), ("b", "2"), ("c", None), ("z", "8")}
    w = lambda *v: spark.range(1).select(integrity.verdict(F.array(*[F.lit(x) for x in v]).cast("array<string>")).alias("v"), integrity.verdict(F.array(*[F.lit(x) for x in v]).cast("array<string>"), worst_wins=True).alias("w")).first()
    assert tuple(w()) == ("pass", "pass") and tuple(w("git", "HASH MISMATCH: x")) == ("warn", "fail")


def test_scrub(spark):
    t = "John Doe, john@x.org\nCall (555) 123-4567 or 5551234567 about John. VIN 1HGCM82633A004352 at 12 Main Street."
    new, changes = scrub.scrub_one(t, {"John": "J", "John Doe": "JD", "": "x"}, [])
    assert new == "JD, redacted@example.invalid\nCall 555-000-0000 or 5551234567 about J. VIN VIN-REDACTED-0000 at [ADDRESS REDACTED]"
    assert [(c[0], c[1]) for c in changes] == [(1, "substitution"), (2, "substitution"), (1, "email"), (2, "phone"), (2, "vin"), (2, "address")]
    assert changes[0][2] == hashlib.sha256(b"John Doe").hexdigest() and scrub.scrub_one(new, {"John": "J"}, [])[0] == new
    assert "5551234567" not in scrub.scrub_one(t, {}, [], strict_digits=True)[0]
    df = scrub.scrub(spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string"), "t")
    assert [r.scrubbed is None for r in df.orderBy("k").collect()] == [False, True, False] and scrub.scrub_report(df, "k").count() == 4
    assert scrub.banned_terms({"ab": "x"}, ["abc", ""]) == ["abc", "ab"]


def test_html():
    raw = b"<html><head><meta charset='utf-8'><title> A &amp; B </title><style>x</style></head><body><p>One</p><script>no</script><ul><li> two<li>three</ul><a href='http://x'>link</a><img alt='pic'>&lt;b&gt;bold&lt;/b&gt;</body></html>"
    body, title, charset = html.render(raw)
    assert (title, charset) == ("A & B", "utf-8") and "One" in body and "- two" in body and "link (http://x)" in body and "[image: pic]bold" in body and "no" not in body.replace("None", "")
    assert html.render(b"")[0] == ""


def test_mail(spark):
    raw = b"From: Ann <ANN@x.org>\r\nTo: b@y.org, \"C, D\" <c@z.org>\r\nSubject: Hi\r\nDate: Mon, 22 Jan 2024 16:57:11 -0800\r\nMessage-ID: <1@x>\r\nContent-Type: text/plain\r\n\r\nBody text\r\n"
    r = spark.createDataFrame([(raw,), (None,)], "c binary").select(mail.parsed(F.col("c")).alias("m")).select("m.*").collect()[0]
    assert r["from"][0]["email"] == "ANN@x.org" and r.to[1]["name"] == "C, D" and r.date_iso == "2024-01-23T00:57:11+00:00" and r.body_text.strip() == "Body text"
    assert mail.utc_iso("nonsense") is None and mail.people(None) == []


def test_threads(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "zz"), ("x", "y"), ("y", "x"), ("w", "x")], "n string, p string")
    roots = {r.node: r.root for r in threads.thread_roots(e, node="n", parent="p").collect()}
    assert [roots[k] for k in "abc"] == ["a", "a", "a"] and roots["d"] == "zz" and [roots[k] for k in "xyw"] == ["x", "x", "x"]
    long = "y" * 90
    c = spark.createDataFrame([(1, 1, "me", long), (1, 2, "you", "q: why"), (2, 1, "you", "a"), (2, 2, "me", "b"), (3, 5, "you", "  [skip — later]")], "root int, id int, author string, text string")
    got = {r.root_id: r for r in threads.thread_catalog(c, root="root", order=["id"], author="author", text="text", me="me").collect()}
    assert got[1].needs_reply and got[1].prior_reply_id == 1 and not got[2].needs_reply and not got[3].needs_reply


def test_tagging_and_timeline(spark):
    m = spark.createDataFrame([(1, "c", "Ann Lee <ann@x.org>", None, "about Bo"), (2, "d", "ann lee", "", ""), (3, None, None, None, None)], "id int, case_id string, f string, t string, s string")
    e = spark.createDataFrame([(10, "c", ["ANN@X.org"], ["Nobody"]), (11, "c", None, ["bo", ""]), (12, "c", [], None), (13, "d", None, ["n l"])], "e int, case_id string, emails array<string>, names array<string>")
    got = timeline.tag_entities(m, e, key="id", case="case_id", hay=["f", "t", "s"], entity="e", emails="emails", names="names")
    assert {tuple(r) for r in got.collect()} == {(1, 10), (1, 11), (2, 13)}
    msgs = spark.createDataFrame([("2024-01-02T03", None, "a", None, 1, "inbound"), ("bad", "x", "a", "b", 2, "inbound")], "date string, subject string, from_addr string, to_addr string, ref_id int, track string")
    r = timeline.union_timeline(messages=msgs).collect()
    assert len(r) == 1 and r[0].title == "(no subject)" and r[0].summary == "from: a" and r[0].marker_date == "2024-01-02"


def test_matching(spark):
    left = spark.createDataFrame([(1, "g", "Consumer Office"), (2, "g", "Consumer Offices"), (3, "g", "Other")], "o int, g string, name string")
    right = spark.createDataFrame([(1, "g", "consumer office")], "o int, g string, name string")
    got = {r.local_name: r.web_name for r in matching.greedy_match(left, right, group=["g"], name="name", order="o").collect()}
    assert got == {"Consumer Office": "consumer office", "Consumer Offices": None, "Other": None}


def test_metadata(spark):
    q = one(spark, "0083;5f5e1000;Safari;ABC", metadata.quarantine)
    assert q.application == "Safari" and q.event_id == "ABC" and one(spark, "x", metadata.quarantine) is None
    assert one(spark, "[ZoneTransfer]\nZoneId=3\nHostUrl=http://h", metadata.zone_identifier).zone == "internet"
    assert one(spark, "https://a", metadata.where_from) == ["https://a"] and one(spark, "hex:00", metadata.where_from) is None

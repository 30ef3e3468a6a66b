import io
import zipfile

from pyspark.sql import functions as F

from docketry.functions import mail, values
from docketry.operators import checks, documents, pages, reports, timeline
from docketry.sources import files

FILES = "path string, sha256 string, live_present boolean"


def test_file_report_of_missing_and_repeated_sections(spark):
    now = spark.createDataFrame([("c/evidence/a.PDF", "h1", True), ("c/notes/.env", None, None), ("c/evidence/new", "h3", False)], FILES)
    lines = spark.createDataFrame([("c/evidence/a.PDF", "old", 1), ("c/evidence/a.PDF", "h1", 2), (None, "x", 3)], "path string, sha256 string, line_no int")
    trail = spark.createDataFrame([("c/evidence/a.PDF", "initial"), ("c/evidence/a.PDF", "content"), (None, "initial")], "path string, change_type string")
    seen = spark.createDataFrame([("c/notes/.env",)], "path string")
    got = {r.path: r for r in reports.file_report(now, manifest=reports.last_recorded(lines), trail=trail, snapshots=seen).collect()}
    a, e, n = got["c/evidence/a.PDF"], got["c/notes/.env"], got["c/evidence/new"]
    assert a.extension == ".pdf" and a.matches and a.line == "git: ⚠ 1 content edit(s); hash: matches manifest ✓; xattr: live-only (not yet snapshotted)" and a.warnings == ["content changed"]
    assert e.extension == "" and e.matches is None and e.line == "git: ⚠ untracked; xattr: snapshot-only (1)"
    assert n.warnings == ["no history", "not in manifest", "no download metadata"]
    empty = reports.file_report(now.limit(0), manifest=lines.drop("line_no").limit(0), trail=trail.limit(0), snapshots=seen.limit(0))
    assert empty.count() == 0


def test_packets_keys_and_gates(spark):
    e = spark.createDataFrame([("p", 1, "A", "x"), ("p", 2, "C", "y"), ("p", 3, None, None), ("q", 1, "A", "x")], "packet string, no int, label string, path string")
    disk = spark.createDataFrame([("x", "1"), ("y", None)], "path string, sha256 string")
    manifest = spark.createDataFrame([("x", "2"), ("y", None)], "path string, sha256 string")
    errors = checks.packet_errors(e, disk, manifest, packet="packet", order="no")
    assert {tuple(r) for r in errors.collect()} == {("p", 1, "stale-hash"), ("p", 2, "out-of-sequence"), ("p", 3, "out-of-sequence"), ("p", 3, "missing-source"), ("q", 1, "stale-hash")}
    assert {(r.packet, r.exit_code, r.errors) for r in checks.packet_status(errors, packet="packet").collect()} == {("p", 2, 4), ("q", 1, 1)}
    gaps = checks.label_gaps(e, group="packet", order=["no"], given="label").collect()
    assert {(r.no, r.expected) for r in gaps} == {(2, "B"), (3, "C")}
    rows = spark.createDataFrame([(1, "c", ["a", "b", "a", None]), (2, "c", None)], "k int, c string, ids array<string>")
    known = spark.createDataFrame([("c", "a"), ("d", "b")], "c string, i string")
    assert [tuple(r) for r in checks.unknown_keys(rows, known, key="k", scope="c", ids="ids", ident="i").collect()] == [(1, "c", "b")]
    nxt = checks.next_ids(spark.createDataFrame([("a", 4)], "g string, i bigint"), spark.createDataFrame([("a",), ("b",)], "g string"), group="g", ident="i", first=1)
    assert {tuple(r) for r in nxt.collect()} == {("a", 5), ("b", 1)}
    web = spark.createDataFrame([("https://www.a.org/x",)], "url string")
    local = spark.createDataFrame([("https://a.org", "Populated"), ("https://b.org", "populated"), ("https://c.org", "stub"), (None, "populated")], "url string, status string")
    assert [r.url for r in checks.stale_hosts(local, web, url="url", status="status").collect()] == ["https://b.org"] and checks.stale_hosts(local, web.limit(0), url="url").count() == 0


def test_edits_in_runs_and_revisions(spark):
    df = spark.createDataFrame([(["see ", "this ", "and"], [False, True, False], f) for f in ("see", "this", "e th", "gone", "", None, "a")] + [(["aa"], [False], "a")], "runs array<string>, mixed array<boolean>, find string")
    got = [r[0] for r in df.select(documents.run_check(F.col("runs"), F.col("mixed"), F.col("find"))).collect()]
    assert got == ["ok", "compound-run", "spans-runs", "not-in-anchor", "not-in-anchor", "not-in-anchor", "ok", "ambiguous"]
    r = spark.range(1).select(documents.tracked(F.lit("see this"), F.lit("this"), F.lit("that"), F.lit("Al"), F.lit(7)).alias("m")).select("m", documents.next_revision(F.col("m")).alias("n"), documents.revision_counts(F.col("m"), "Al").alias("c")).first()
    assert r.n == 9 and tuple(r.c) == (1, 1) and r.m.startswith("see <w:del")
    assert spark.range(1).select(documents.next_revision(F.lit("none"))).first()[0] == 1


def test_anchors_and_text_of_word_processor_files(spark):
    w = 'xmlns:w="urn:w"'
    body = f'<w:document {w}><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:commentRangeStart w:id="4"/><w:r><w:t>tied </w:t></w:r><w:r><w:tab/><w:t>text</w:t></w:r><w:commentRangeEnd w:id="4"/><w:r><w:t> after</w:t></w:r></w:p></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    members = files.zip_members(spark.createDataFrame([("d", buf.getvalue())], "path string, content binary"))
    a = files.document_anchors(members).first()
    assert (a.id, a.para_idx, a.anchor, a.runs, a.compound) == (4, 1, "tied text", ["tied ", "text"], [False, True])
    assert tuple(files.document_text(members).first()) == ("d", "Title\ntied text after", "Title") and files.document_text(members.limit(0)).count() == 0


def test_html_cascade_and_forced_tiers(spark):
    good = "the plain words of a page that is long enough to read " * 8
    docs = spark.createDataFrame([(1, good, None, None, 500), (2, "short", good, "longer " * 200, 900), (3, None, None, None, 0), (4, "short", "tiny", None, 90_000)], "k int, a string, b string, c string, raw int")
    got = {r.k: (r.text, r.tier) for r in pages.html_cascade(docs, tiers=["a", "b", "c"], raw_length="raw", key="k").collect()}
    assert got == {1: (good, 0), 2: (good, 1), 3: ("", 0), 4: ("short", 0)}
    assert {r.k: r.tier for r in pages.html_cascade(docs, tiers=["a", "b", "c"], raw_length="raw", key="k", force=2).collect()}[2] == 2
    p = spark.createDataFrame([(1, "x", False)], "page_id int, text string, garbled boolean")
    assert pages.escalate([p, p.withColumn("text", F.lit("y"))], keys=["page_id"], force=1).first().text == "y"


def test_typed_days_and_orders(spark):
    days = {"2024-02-30": ("2024-02-30", "unreadable"), " March 4, 1998 ": ("1998-03-04", "interpreted"), "3/4/70": ("1970-03-04", "interpreted"), "4 mar 2024": ("2024-03-04", "interpreted"), "May 2024": ("2024-05-01", "interpreted"), "2024-02-29": ("2024-02-29", None), "": ("", None), None: (None, None)}
    df = spark.createDataFrame([(k,) for k in days], "d string")
    assert {r.d: (r.t.value, r.t.warning) for r in df.select("d", values.typed_day(F.col("d")).alias("t")).collect()} == days
    m = spark.createDataFrame([(1, "c", "2024", "b", "t"), (2, "c", None, "a", "t"), (3, "c", "2024", "a", None), (4, "d", "2020", "z", "z")], "k int, c string, marker_date string, kind string, title string")
    assert {r.k: r.place for r in timeline.timeline_places(m, scope="c", key="k").collect()} == {2: 1, 3: 2, 1: 3, 4: 1}
    ev = spark.createDataFrame([(1, "c", ["a", "b"]), (2, "c", ["x"]), (3, "c", None)], "k int, c string, ids array<string>")
    en = spark.createDataFrame([("c", "a", "self"), ("c", "b", "adversary"), ("d", "x", "self")], "c string, i string, role string")
    got = {r.k: (r.track, r.parties) for r in timeline.event_tracks(ev, en, key="k", scope="c", ids="ids", ident="i", role="role").collect()}
    assert got == {1: ("adverse_event", "a:self,b:adversary"), 2: ("neutral_event", "x:neutral"), 3: ("neutral_event", "")}


def test_transcripts(spark):
    raw = b"From: Ann <ann@x.org>\nTo: b@x.org\nSubject: Hi\n\nBody"
    r = spark.createDataFrame([(raw,)], "c binary").select(mail.transcript(mail.parsed(F.col("c"))).alias("t")).first().t
    assert r == "From: Ann <ann@x.org>\nTo: b@x.org\nSubject: Hi\n\nBody"


def test_references_with_gaps(spark):
    from docketry.operators import references

    cols = "n int, path string, content binary, content_type string, citation string, url string"
    docs = spark.createDataFrame([(1, "a.txt", b"one", None, "MD 1", None), (2, "b.txt", b"one", None, "MD 1", None), (3, None, b"", "text/plain", "MD 1", None), (4, "c.txt", None, None, None, None), (5, "d.doc", b"x", "application/msword", None, "https://www.h.org/p")], cols)
    got = {r.n: r for r in references.ingest(docs, spark.createDataFrame([], "source_id string"), order="n", kind=F.lit("other")).collect()}
    assert set(got) == {1, 3, 5} and got[1].slug == "md-1" and got[3].slug == "md-1-2" and got[5].slug == "h-org-p"
    assert got[3].flags == "empty" and got[5].refused and got[5].text is None and got[1].text == "one"
    again = references.ingest(docs, spark.createDataFrame([(got[1].source_id,)], "source_id string"), order="n", kind=F.lit("other"))
    assert {r.n for r in again.collect()} == {3, 5} and references.ingest(docs.limit(0), docs.select(F.lit("x").alias("source_id")), order="n", kind=F.lit("o")).count() == 0
    rows = spark.createDataFrame([(1, "local"), (2, "net"), (3, None), (4, "other")], "n int, provider string")
    yes = spark.createDataFrame([("net", True), ("other", None)], "provider string, granted boolean")
    assert {r.n for r in references.consented(rows, yes, provider="provider", local=["local"]).collect()} == {1, 2}

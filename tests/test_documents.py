from pyspark.sql import Row
from pyspark.sql import functions as F

from docketry.operators import documents as D
from docketry.operators import lookups as L


def test_dispatch_and_finish(spark):
    df = spark.createDataFrame([("a.html", b"<p>Hi</p>", "text/html; charset=x"), ("b.txt", b"plain", None), ("c.doc", b"x", None), ("d.pdf", None, "")], "path string, content binary, content_type string")
    got = {r.path: r for r in D.reference_text(df).collect()}
    assert got["a.html"].text.strip() == "Hi" and got["b.txt"].text == "plain" and got["c.doc"].refused and got["d.pdf"].text is None
    pages = spark.createDataFrame([(1, "a[b c"), (2, "x")], "page_number int, text string")
    assert [r.text for r in D.finished(pages, skip=[2], strip=["[b", r"\s"]).collect()] == ["ac"]
    f = spark.createDataFrame([("x.xml", b""), ("y", b"SQLite format 3"), ("z.csv", b""), ("q", None)], "p string, c binary").select(D.export_format(F.col("p"), F.col("c")).alias("f"))
    assert [r.f for r in f.collect()] == ["android-xml", "sqlite", "csv", "unknown"]


def test_texts(spark):
    r = D.compared(spark.createDataFrame([("a\nb", "a\nc"), (None, "")], "l string, r string"), "l", "r").collect()
    assert not r[0].same and "-b" in r[0].diff and r[1].same and r[1].diff_lines == 0
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    s = lambda v: F.lit(v).cast("string")
    assert one(D.reference_slug(s(""), s("https://www.x.org/a/b"), s(None))) == "x-org-a-b" and one(D.reference_slug(s(None), s(None), s("d/My File.pdf"))) == "my-file" and one(D.reference_slug(s(None), s(None), s(None))) == "ref"
    assert one(D.citation(s("a"), s("f" * 64), s(None), F.lit(3))) == "[source: a:3; sha256 ffffffffffffffff; undated]"
    assert one(D.call_text(s("1"), s(""), s("incoming"), s(None), F.lit(5), s("hi"))) == "From: <1>\nDirection: incoming\nSeconds: 5\n\nhi"
    assert [one(D.edit_check(s("a b a"), s(x))) for x in ("b", "a", "z", "")] == ["ok", "ambiguous", "not-in-anchor", "not-in-anchor"] and one(D.edited(s("a b"), s("b"), s("c"))) == "a c"
    assert one(D.fidelity(F.lit(100), F.lit(0))).low is None and one(D.fidelity(F.lit(100), F.lit(1))).low


def test_facts_and_mentions(spark):
    facts = spark.createDataFrame([Row(f=Row(parties=Row(p1=Row(name="A", tags=["x"])), city="B"))])
    leaves = D.flattened(facts, "f")
    assert {tuple(r) for r in leaves.collect()} == {("parties.p1.name", "A"), ("parties.p1.tags", '["x"]'), ("city", "B")}
    e = spark.createDataFrame([(1, "parties.p1"), (2, "parties.p9"), (3, None)], "id int, ref_path string")
    got = {r.id: r for r in D.resolved(e, leaves).collect()}
    assert got[1].resolved["name"] == "A" and got[2].missing and not got[3].missing
    m = D.mentions(spark.createDataFrame([("see a.pdf, b.txt",), ("none",), (None,)], "line string"), spark.createDataFrame([("x/a.pdf",), ("y/c.pdf",)], "path string"))
    assert [(r.path, r.line) for r in m.collect()] == [("x/a.pdf", "see a.pdf, b.txt")]


def test_lookups(spark):
    df = spark.createDataFrame([("raw/x/raw/a.eml", "A", None), ("q", "", "I")], "p string, a string, i string")
    got = df.select(L.sibling(F.col("p"), "structured", ".json").alias("s"), L.role_of(F.col("a"), F.col("i"), [{"author": "A", "initials": "Z", "role": "r0"}, {"author": "A", "role": "r1"}], "none").alias("r"), L.under(F.col("p"), ["raw/"]).alias("u")).collect()
    assert [tuple(r) for r in got] == [("structured/x/raw/a.json", "r1", True), ("q", "none", False)]
    c = L.changed_files(spark.createDataFrame([("R100", "old", "new"), ("M", None, "m")], "status string, old_path string, path string")).collect()
    assert {tuple(r) for r in c} == {("D", "old"), ("A", "new"), ("M", "m")}
    s = spark.createDataFrame([("# Head\n\n  One\ntwo\n\nthree",), (None,)], "t string").select(L.first_paragraph(F.col("t")).alias("f"), L.capped(F.split("t", "\n"), 2).alias("c")).collect()
    assert s[0].f == "One two" and s[0].c.truncated and s[1].f is None
    u = L.unique_slugs(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, s string"), "s", ["i"]).orderBy("i").collect()
    assert [r.unique_slug for r in u] == ["a", "a-2", None]

import io
import mailbox
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from docketry.sources import files, sinks
from docketry.streaming import ingest


def test_trees_and_manifests(spark, tmp_path):
    root = tmp_path / "tree"
    for p, b in (("a/x.txt", b"one"), ("a/.hidden", b"h"), ("b/y.tmp", b"two"), ("b/z.png", b"\xff\xfe")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    assert {r.path for r in files.tree(spark, str(root), exclude=["*.tmp"]).collect()} == {"a/x.txt", "b/z.png"}  # names with a dot are hidden from file scans
    assert {r.path for r in files.evidence_tree(spark, str(root)).collect()} == {"a/x.txt", "b/y.tmp", "b/z.png"}
    assert {r.path for r in files.text_targets(spark, str(root)).collect()} >= {"a/x.txt", "b/y.tmp"}
    snap = files.snapshot(spark, str(root))
    sinks.write_shasum(snap.select("sha256", "path"), str(tmp_path / "m"))
    assert files.shasum(spark, str(tmp_path / "m")).count() == snap.count()


def test_tables_of_exports(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿Number, Name,Direction,Timestamp,duration_seconds,transcript,x\n1,Al,INCOMING,1700000000000,5,\"a, b\",z\n2,,fax,2024-01-01T00:00:00Z,x,,\n")
    r = files.call_log(spark, str(tmp_path / "c.csv")).orderBy("caller_number").collect()
    assert r[0].direction == "incoming" and r[0].timestamp_iso == "2023-11-14T22:13:20+00:00" and r[0].transcript == "a, b" and r[1].direction == "unknown:fax" and r[1].duration_seconds is None
    (tmp_path / "e.csv").write_text("Date_of_service,Provider,cpt_code,description,billed,allowed,patient_responsibility,claim_id\n03/01/2024,P,1,d,\"$2,100.00\",,5,C1\n")
    e = files.benefit_lines(spark, str(tmp_path / "e.csv")).first()
    assert e.date_of_service == "2024-03-01" and str(e.billed) == "2100.00" and e.extra == {"claim_id": "C1"}
    (tmp_path / "s.xml").write_text('<smses count="2"><sms address="+1555" date="1700000000000" type="1" body="hi" contact_name="A" thread_id="7"/><mms x="1"/><sms address="2" date="x" type="9" body="yo"/></smses>')
    s = files.sms_export(spark, str(tmp_path / "s.xml")).orderBy("address").collect()
    assert [x.direction for x in s] == ["incoming", "unknown"] and s[0].address == "+1555" and s[1].date_iso is None


def test_mailboxes_and_documents(spark, tmp_path):
    box = mailbox.mbox(tmp_path / "m.mbox")
    for i in range(3):
        box.add(f"From: a{i}@x.org\nTo: b@x.org\nSubject: s{i}\nMessage-ID: <{i}@x>\n\nbody {i}\nFrom here on\n")
    box.flush()
    got = files.messages(spark, mailboxes=str(tmp_path / "m.mbox")).orderBy("subject").collect()
    assert [r.message_id for r in got] == ["<0@x>", "<1@x>", "<2@x>"] and "From here on" in got[0].body_text and got[2].source.endswith("#2")
    w = 'xmlns:w="urn:w" xmlns:p="urn:p"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment w:id="4" w:author="Al" w:initials="A" w:date="2024"><w:p p:paraId="P1"><w:r><w:t>Hello</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("word/commentsExtended.xml", f'<p:x {w}><p:commentEx p:paraId="P1" p:paraIdParent="P0"/></p:x>')
    df = spark.createDataFrame([("d", buf.getvalue()), ("broken", b"no zip"), ("none", None)], "path string, content binary")
    c = files.document_comments(files.zip_members(df)).collect()
    assert len(c) == 1 and (c[0].id, c[0].parent_para_id, c[0].author, c[0].text) == (4, "P0", "Al", "Hello")


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(i, f"k{i % 7}", f"2024-01-0{1 + i % 3}T00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("daily").collect()} == {tuple(r) for r in ingest.daily_counts(df).collect()}
    go = lambda: ingest.keyed_append(stream, str(tmp_path / "out"), key="event_type", time="ts", store=str(tmp_path / "seen"), checkpoint=str(tmp_path / "cp")).awaitTermination()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    df.withColumn("event_type", F.concat("event_type", F.when(F.col("id") < 3, F.lit("x")).otherwise(F.lit("")))).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_message_store_keeps_one_copy_over_batches_and_replays(spark, tmp_path):
    from docketry.operators.redelivery import MessageStore

    store = MessageStore(spark, str(tmp_path / "store"), words=64)
    cols = "k bigint, m string, at timestamp_ntz"
    take = lambda rows, n: sorted(r.k for r in store.accept(spark.createDataFrame(rows, cols), n, key="k", ident=F.col("m"), delivered="at").collect())
    a, b = datetime(2024, 1, 1), datetime(2024, 6, 1)
    one = [(i, f"m{i % 40}", b if i % 2 else a) for i in range(80)] + [(900, None, None)]
    assert take(one, 0) == [*range(40), 900]
    assert take(one, 0) == [*range(40), 900]
    assert take([(100 + i, f"m{i}", None) for i in range(60)], 1) == [*range(140, 160)]
    assert take([(200 + i, f"m{i}", a) for i in range(60)], 2) == []

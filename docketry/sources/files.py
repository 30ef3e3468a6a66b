"""Files and file formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.rules import glob_regex
from docketry.functions.text import basename, filled
from docketry.functions.values import day_or_text, epoch_or_iso, money, whole

# Suffixes of files that are never scrubbed as text.
BINARY = {"pdf", "docx", "xlsx", "pptx", "zip", "tar", "gz", "jpg", "jpeg", "png", "gif", "heic", "heif", "tiff", "mp3", "mp4", "mov", "wav"}


def tree(spark: SparkSession, root: str, *, exclude: list[str] | None = None, content: bool = True, glob: str | None = None) -> DataFrame:
    """(path relative to root, length, modified, content) of all files below a folder.

    ``exclude``: globs over the relative path or the file name, in which ``*`` crosses ``/``. Contents are
    read only where a later step asks for them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    full = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/"
    df = df.withColumn("path", F.substr(full, F.instr(full, start) + len(start)))
    for g in exclude or []:
        p = "(?s)" + glob_regex(g, cross=True)
        df = df.where(~F.col("path").rlike(p) & ~basename(F.col("path")).rlike(p))
    cols = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else [])]
    return df.select(*cols)


def evidence_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files of an evidence tree: names beginning with a dot are left out."""
    return tree(spark, root).where(~F.startswith(basename(F.col("path")), F.lit(".")))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """One row per file: (path, size, modified, sha256)."""
    return tree(spark, root).select("path", "size", "modified", F.sha2("content", 256).alias("sha256"))


def text_targets(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of files that may be scrubbed: no binary suffix, valid UTF-8."""
    df = tree(spark, root).where(~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*sorted(BINARY)))
    return df.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def shasum_lines(lines: DataFrame, *, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(sha256, path, and the columns to keep) of ``<hex>  <path>`` lines; comments, blank lines and lines without two blanks fall out."""
    ok = (F.trim(value) != "") & ~F.startswith(F.ltrim(value), F.lit("#")) & F.contains(F.col(value), F.lit("  "))
    parts = F.split(value, "  ", 2)
    return lines.where(ok).select(F.trim(F.get(parts, F.lit(0))).alias("sha256"), F.trim(F.get(parts, F.lit(1))).alias("path"), *(keep or []))


def shasum(spark: SparkSession, path: str) -> DataFrame:
    return shasum_lines(spark.read.text(path))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])


def call_rows(df: DataFrame) -> DataFrame:
    """Rows of call exports, all columns text: an unknown direction becomes ``unknown:<value>``; columns that are missing are null, others are dropped."""
    col = lambda n: filled(F.trim(F.col(n))) if n in df.columns else F.lit(None).cast("string")
    known = F.lower(col("direction")).isin("incoming", "outgoing", "missed", "voicemail")
    direction = F.when(known, F.lower(col("direction"))).when(col("direction").isNotNull(), F.concat(F.lit("unknown:"), F.lower(col("direction"))))
    stamp = epoch_or_iso(col("timestamp"))
    return df.select(
        col("number").alias("caller_number"), col("name").alias("contact_name"), direction.alias("direction"), F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("timestamp_iso"),
        whole(col("duration_seconds")).alias("duration_seconds"), col("transcript").alias("transcript"),
    )


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Call exports as CSV with headers in any case, by ``call_rows``."""
    return call_rows(_csv(spark, path))


BENEFIT = ("date_of_service", "provider", "cpt_code", "description", "billed", "allowed", "patient_responsibility")


def benefit_rows(df: DataFrame) -> DataFrame:
    """Rows of benefit statements, all columns text: known columns typed, all others kept in the map ``extra``."""
    col = lambda n: F.trim(F.col(n)) if n in df.columns else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in BENEFIT]
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.create_map().cast("map<string,string>")
    return df.select(
        day_or_text(col("date_of_service")).alias("date_of_service"), *[col(c).alias(c) for c in BENEFIT[1:4]], *[money(col(c)).alias(c) for c in BENEFIT[4:]],
        F.map_filter(extra, lambda k, v: F.coalesce(v, F.lit("")) != "").alias("extra"),
    )


def benefit_lines(spark: SparkSession, path: str) -> DataFrame:
    """Benefit statements as CSV, by ``benefit_rows``."""
    return benefit_rows(_csv(spark, path))


def benefit_totals(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the three amounts; missing ones count as nothing, and no amount at all sums up to 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)").alias(c)
    return lines.groupBy(*(by or [])).agg(*[total(c) for c in BENEFIT[4:]])


_SMS = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("address", "date", "type", "body", "contact_name", "thread_id", "service_center", "readable_date")])


def sms_rows(df: DataFrame) -> DataFrame:
    """Attributes of a phone's messages as records; a type other than 1 and 2 is unknown."""
    ms = F.col("_date").try_cast("bigint")
    return df.select(
        F.when(F.col("_type") == "1", "incoming").when(F.col("_type") == "2", "outgoing").otherwise("unknown").alias("direction"), F.col("_address").alias("address"), filled(F.col("_contact_name")).alias("contact_name"),
        F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("date_iso"), ms.alias("date_raw_ms"), F.col("_body").alias("body"), F.lit("SMS").alias("service"), filled(F.col("_thread_id")).alias("thread_id"),
    )


def sms_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a phone's XML export, by ``sms_rows``; multimedia messages are left out."""
    return sms_rows(spark.read.format("xml").option("rowTag", "sms").schema(_SMS).load(path))


def json_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Entries of snapshot files: (captured_at, path, size, mtime, sha256, xattrs)."""
    schema = "captured_at string, count int, entries array<struct<path:string,size:bigint,mtime:double,sha256:string,xattrs:map<string,string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("captured_at", F.explode("entries").alias("e")).select("captured_at", "e.*")


def text_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the older text form, ``File: name`` blocks between lines of equals signs: (file, name, body)."""
    df = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    blocks = F.filter(F.split("value", r"(?m)^={10,}\s*$"), lambda b: F.trim(b) != "")
    rows = df.select("file", F.posexplode(blocks).alias("pos", "block"))
    return rows.select("file", F.trim(F.regexp_extract("block", r"(?m)^\s*File:\s*(.+)$", 1)).alias("name"), F.lead("block").over(_by_file()).alias("body"), "pos").where(F.col("name") != "")


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("pos")


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, content): one row per message of mbox files, split at their ``From `` lines inside each file's task."""
    df = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches):
        import pandas as pd

        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                starts = [i + 1 for i in range(len(raw) - 6) if raw[i : i + 6] == b"\nFrom "]
                starts = ([0] if raw[:5] == b"From " else []) + starts
                parts = [bytes(raw[a:e]).split(b"\n", 1)[-1].replace(b"\n>From ", b"\nFrom ") for a, e in zip(starts, starts[1:] + [len(raw)])]
                yield pd.DataFrame({"file": [p] * len(parts), "index": range(len(parts)), "content": parts})

    return df.mapInPandas(split, "file string, index int, content binary")


def messages(spark: SparkSession, *, eml: str | None = None, mailboxes: str | None = None) -> DataFrame:
    """Parsed mail of .eml files and mailboxes: (source, message.*); a mailbox message is named ``path#i``."""
    from docketry.functions.mail import parsed

    parts = []
    if eml:
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml").load(eml).select(F.col("path").alias("source"), "content"))
    if mailboxes:
        parts.append(mbox(spark, mailboxes).select(F.concat_ws("#", "file", F.col("index").cast("string")).alias("source"), "content"))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return df.withColumn("m", parsed(F.col("content"))).select("source", "m.*")


def zip_members(df: DataFrame, content: str = "content", *, key: str = "path") -> DataFrame:
    """(key, member, data) of zip containers such as office documents; broken ones give no rows."""

    def read(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            rows = []
            for k, raw in zip(b[key], b[content]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(raw)))
                    rows += [(k, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "member", "data"])

    return df.select(key, content).mapInPandas(read, f"{key} string, member string, data binary")


def document_comments(members: DataFrame, *, key: str = "path") -> DataFrame:
    """(key, id, para_id, parent_para_id, author, initials, date, text) of the comments of word-processor files."""
    wanted = members.where(F.col("member").isin("word/comments.xml", "word/commentsExtended.xml"))
    pair = wanted.groupBy(key).agg(F.max(F.when(F.col("member") == "word/comments.xml", F.col("data"))).alias("c"), F.max(F.when(F.col("member") != "word/comments.xml", F.col("data"))).alias("x"))

    def read(batches):
        import xml.etree.ElementTree as E

        import pandas as pd

        local = lambda t: t.rsplit("}", 1)[-1]
        get = lambda e, n: next((v for k, v in e.attrib.items() if local(k) == n), None)
        for b in batches:
            rows = []
            for k, c, x in zip(b[key], b["c"], b["x"]):
                up = {get(e, "paraId"): get(e, "paraIdParent") for e in E.fromstring(bytes(x)).iter() if local(e.tag) == "commentEx"} if x is not None else {}
                for e in E.fromstring(bytes(c)).iter() if c is not None else ():
                    if local(e.tag) == "comment":
                        paras = [p for p in e.iter() if local(p.tag) == "p"]
                        pid = get(paras[-1], "paraId") if paras else None
                        text = "\n".join("".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in paras)
                        rows.append((k, int(get(e, "id")), pid, up.get(pid), get(e, "author"), get(e, "initials"), get(e, "date"), text.strip()))
            yield pd.DataFrame(rows, columns=[key, "id", "para_id", "parent_para_id", "author", "initials", "date", "text"])

    return pair.mapInPandas(read, f"{key} string, id int, para_id string, parent_para_id string, author string, initials string, date string, text string")


def document_anchors(members: DataFrame, *, key: str = "path", limit: int = 800) -> DataFrame:
    """(key, id, para_idx, anchor, runs, compound) of the text that each comment of a word-processor file is tied to.

    ``anchor`` is cut at ``limit`` characters, as the form of a report; ``runs`` are the texts of the runs inside
    the range, ``compound`` whether each holds more than plain text (a tab, a break, a field).
    """
    wanted = members.where(F.col("member") == "word/document.xml").select(key, "data")

    def read(batches):
        import xml.etree.ElementTree as E

        import pandas as pd

        local = lambda t: t.rsplit("}", 1)[-1]
        get = lambda e, n: next((v for k, v in e.attrib.items() if local(k) == n), None)
        for b in batches:
            rows = []
            for k, raw in zip(b[key], b["data"]):
                open_: dict[int, dict] = {}
                para = -1
                for e in E.fromstring(bytes(raw)).iter():
                    name = local(e.tag)
                    if name == "p":
                        para += 1
                    elif name == "commentRangeStart":
                        open_[int(get(e, "id"))] = {"para": para, "runs": [], "mixed": [], "on": True}
                    elif name == "commentRangeEnd" and int(get(e, "id")) in open_:
                        open_[int(get(e, "id"))]["on"] = False
                    elif name == "r":
                        text = "".join(t.text or "" for t in e if local(t.tag) == "t")
                        mixed = any(local(t.tag) not in ("t", "rPr") for t in e) or sum(local(t.tag) == "t" for t in e) > 1
                        for r in open_.values():
                            if r["on"] and (text or mixed):
                                r["runs"].append(text)
                                r["mixed"].append(mixed)
                rows += [(k, i, r["para"], "".join(r["runs"])[:limit], r["runs"], r["mixed"]) for i, r in open_.items()]
            yield pd.DataFrame(rows, columns=[key, "id", "para_idx", "anchor", "runs", "compound"])

    return wanted.mapInPandas(read, f"{key} string, id int, para_idx int, anchor string, runs array<string>, compound array<boolean>")


def document_text(members: DataFrame, *, key: str = "path") -> DataFrame:
    """(key, text, title) of word-processor files: paragraphs as lines, and the first that is not blank."""
    wanted = members.where(F.col("member") == "word/document.xml").select(key, "data")

    def read(batches):
        import xml.etree.ElementTree as E

        import pandas as pd

        local = lambda t: t.rsplit("}", 1)[-1]
        for b in batches:
            rows = []
            for k, raw in zip(b[key], b["data"]):
                paras = ["".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in E.fromstring(bytes(raw)).iter() if local(p.tag) == "p"]
                rows.append((k, "\n".join(paras), next((p.strip() for p in paras if p.strip()), None)))
            yield pd.DataFrame(rows, columns=[key, "text", "title"])

    return wanted.mapInPandas(read, f"{key} string, text string, title string")

"""Documents and their records: dispatch, finishing, comparison, citation, rendering, nested facts."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.html import rendered
from docketry.functions.text import basename, citation_slug, content_type, filled, host


def export_format(path: Column, content: Column) -> Column:
    """android-xml, csv, sqlite or unknown, by suffix and the first bytes of an export."""
    head = F.substring(content, 1, 4096).cast("string")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when((suffix == "xml") | F.contains(head, F.lit("<smses")), "android-xml").when((suffix.isin("db", "sqlite", "storedata")) | F.startswith(head, F.lit("SQLite format 3")), "sqlite").when(suffix == "csv", "csv").otherwise("unknown")


def reference_text(df: DataFrame, *, path: str = "path", content: str = "content", declared: str = "content_type") -> DataFrame:
    """Add kind, text and title by content type: HTML is rendered, plain text decoded; PDF and office types keep null text for their own readers; old .doc is refused."""
    df = df.withColumn("kind", content_type(F.col(declared), F.col(path)))
    page = F.when(F.col("kind") == "text/html", F.col(content))
    df = df.withColumn("_r", rendered(page))
    plain = F.when(F.startswith("kind", F.lit("text/")) & (F.col("kind") != "text/html"), F.make_valid_utf8(F.col(content).cast("string")))
    return df.withColumn("text", F.coalesce("_r.text", plain)).withColumn("title", F.col("_r.title")).withColumn("refused", F.col("kind") == "application/msword").drop("_r")


def finished(pages: DataFrame, *, text: str = "text", number: str = "page_number", skip: list[int] | None = None, strip: list[str] | None = None) -> DataFrame:
    """Final overrides: pages to leave out, and patterns to take off; a pattern that is no regular expression counts as plain text."""
    out = pages.where(~F.col(number).isin(*skip)) if skip else pages
    for p in strip or []:
        try:
            re.compile(p)
            out = out.withColumn(text, F.regexp_replace(text, p, ""))
        except re.error:
            out = out.withColumn(text, F.replace(text, F.lit(p), F.lit("")))
    return out


def reference_slug(citation: Column, url: Column, path: Column) -> Column:
    """Slug of the citation, else of host and path of the address, else of the file's stem, else ``ref``."""
    where = F.concat_ws("-", host(url), F.try_parse_url(url, F.lit("PATH")))
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return citation_slug(F.coalesce(filled(citation), filled(where), filled(stem), F.lit("ref")))


def _diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm="", n=2)) for x, y in zip(a, b)])


def compared(df: DataFrame, left: str, right: str, *, limit: int = 500) -> DataFrame:
    """Add same, delta (characters) and diff: up to ``limit`` lines of a unified diff as a report, with diff_lines and truncated for the whole."""
    lines = F.pandas_udf(_diff, "array<string>")(F.col(left), F.col(right))
    df = df.withColumn("_d", lines)
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    return df.withColumns({"same": a == b, "delta": F.length(b) - F.length(a), "diff": F.slice("_d", 1, limit), "diff_lines": F.size("_d"), "truncated": F.size("_d") > limit}).drop("_d")


def fidelity(chars: Column, pages: Column, floor: int = 200) -> Column:
    """Struct (chars_per_page, low) of a compiled document; null pages or none give null."""
    per = chars / F.nullif(pages, F.lit(0))
    return F.struct(per.alias("chars_per_page"), (per < floor).alias("low"))


def citation(path: Column, sha256: Column, recorded: Column, line: Column) -> Column:
    """Footer naming a file, its line, its digest and where its date comes from."""
    at = F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("[source: "), path, at, F.lit("; sha256 "), F.coalesce(F.left(sha256, F.lit(16)), F.lit("unknown")), F.lit("; "), F.coalesce(recorded, F.lit("undated")), F.lit("]"))


def call_text(number: Column, name: Column, direction: Column, stamp: Column, seconds: Column, transcript: Column) -> Column:
    """A call as lines for people; what is missing gives no line."""
    row = lambda label, c: F.when(filled(c.cast("string")).isNotNull(), F.concat(F.lit(label + ": "), c.cast("string")))
    return F.concat_ws("\n", row("From", F.concat_ws(" ", filled(name), F.when(filled(number).isNotNull(), F.concat(F.lit("<"), number, F.lit(">"))))), row("Direction", direction), row("At", stamp), row("Seconds", seconds), F.when(filled(transcript).isNotNull(), F.concat(F.lit("\n"), transcript)))


def pdf_date(stamp: Column) -> Column:
    return F.date_format(stamp, "'D:'yyyyMMddHHmmss'Z'")


def flattened(facts: DataFrame, root: str) -> DataFrame:
    """(path, value) of every leaf of a nested column: dotted paths as the schema names them. Arrays and maps are leaves, as JSON."""

    def leaves(t: T.DataType, at: str, col: Column):
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from leaves(f.dataType, f"{at}.{f.name}" if at else f.name, col[f.name])
        else:
            yield at, F.to_json(col) if isinstance(t, T.ArrayType | T.MapType) else col.cast("string")

    pairs = [F.struct(F.lit(p).alias("path"), c.alias("value")) for p, c in leaves(facts.schema[root].dataType, "", F.col(root))]
    return facts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def resolved(entities: DataFrame, leaves: DataFrame, ref: str = "ref_path") -> DataFrame:
    """Entities with ``resolved`` (the facts below their path, as a map) and ``missing``: a path that leads to no block."""
    block = leaves.withColumn("block", F.regexp_replace("path", r"\.[^.]*$", "")).where(F.contains("path", F.lit("."))).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct(F.regexp_extract("path", r"[^.]*$", 0), "value"))).alias("resolved"))
    out = entities.join(block, entities[ref] == block["block"], "left").drop("block")
    return out.withColumn("missing", (F.coalesce(ref, F.lit("")) != "") & F.col("resolved").isNull())


def mentions(lines: DataFrame, files: DataFrame, *, line: str = "line", path: str = "path") -> DataFrame:
    """(path, line) of catalog lines that name a file: the words of a line are joined with the files' names, and longer hits checked."""
    words = lines.select(line, F.explode(F.array_distinct(F.regexp_extract_all(line, F.lit(r"[\w.()+-]+\.[A-Za-z0-9]+"), F.lit(0)))).alias("name"))
    names = files.select(path, basename(F.col(path)).alias("name"))
    return words.join(names, "name").select(path, line)


def edit_check(anchor: Column, find: Column) -> Column:
    """Whether a text may be edited inside its anchor: ok, not-in-anchor or ambiguous."""
    n = F.when(filled(find).isNotNull(), (F.length(anchor) - F.length(F.replace(anchor, find, F.lit("")))) / F.length(find))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "not-in-anchor").when(n > 1, "ambiguous").otherwise("ok")


def run_check(runs: Column, compound: Column, find: Column) -> Column:
    """``edit_check`` for an anchor of several runs: the text found must lie in one run (spans-runs), which holds plain text only (compound-run)."""
    whole = edit_check(F.array_join(F.transform(runs, lambda r: F.coalesce(r, F.lit(""))), ""), find)
    inside = F.filter(F.arrays_zip(runs.alias("r"), compound.alias("c")), lambda x: F.contains(x["r"], find))
    return F.when(whole != "ok", whole).when(F.size(inside) == 0, "spans-runs").when(F.get(inside, F.lit(0))["c"], "compound-run").otherwise("ok")


def edited(anchor: Column, find: Column, replace: Column) -> Column:
    """The anchor with the one occurrence replaced; unchanged where ``edit_check`` does not say ok."""
    return F.when(edit_check(anchor, find) == "ok", F.replace(anchor, find, replace)).otherwise(anchor)


def tracked(anchor: Column, find: Column, replace: Column, author: Column, first_id: Column) -> Column:
    """The edit as a deletion and an insertion that a reader can accept or refuse, as markup with the next two revision numbers; unchanged where it is not allowed."""
    mark = lambda kind, tag, text, n: F.concat(F.lit(f'<w:{kind} w:id="'), (first_id + n).cast("string"), F.lit('" w:author="'), author, F.lit(f'"><w:r><w:{tag}>'), text, F.lit(f"</w:{tag}></w:r></w:{kind}>"))
    return F.when(edit_check(anchor, find) == "ok", F.replace(anchor, find, F.concat(mark("del", "delText", find, 0), mark("ins", "t", replace, 1)))).otherwise(anchor)


def next_revision(markup: Column) -> Column:
    """One more than the largest revision number of a text's markup, 1 if it has none."""
    ids = F.transform(F.regexp_extract_all(markup, F.lit(r'<w:(?:ins|del)\b[^>]*\bw:id="(\d+)"'), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(ids) + 1, F.lit(1))


def revision_counts(markup: Column, author: str) -> Column:
    """Struct (insertions, deletions) of an author in a text's markup."""
    n = lambda kind: F.regexp_count(markup, F.lit(rf'<w:{kind}\b[^>]*\bw:author="{author}"')).cast("int")
    return F.struct(n("ins").alias("insertions"), n("del").alias("deletions"))


def dispatched(df: DataFrame, rules: list[tuple[list[str], str, str]], handlers: dict, *, path: str = "path") -> DataFrame:
    """Add handler, handled and warning: the first rule (suffixes, folder, handler) whose suffix and folder both fit names the handler of a file.

    ``handlers`` are name -> function of the row's columns; a rule that names none that exists gives a warning,
    and files that no rule fits get neither.
    """
    from docketry.operators.lookups import under

    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    name = F.coalesce(*[F.when(ext.isin(*suffixes) & under(F.col(path), [folder]), F.lit(handler)) for suffixes, folder, handler in rules], F.lit(None).cast("string"))
    out = df.withColumn("handler", name)
    done = F.coalesce(*[F.when(F.col("handler") == h, f(out)) for h, f in handlers.items()], F.lit(None).cast("string"))
    return out.withColumn("handled", done).withColumn("warning", F.when(F.col("handler").isNotNull() & ~F.col("handler").isin(*handlers), F.concat(F.lit("unknown handler: "), F.col("handler"))))


def frontmatter(text: Column, keys: list[str]) -> Column:
    """Map of the chosen keys of the ``key: value`` lines between a text's leading ``---`` lines; empty without such a block."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    values = [(F.lit(k), F.trim(F.regexp_extract(block, rf"(?m)^{re.escape(k)}[ \t]*:[ \t]*(.*)$", 1))) for k in keys]
    return F.map_filter(F.create_map(*[x for kv in values for x in kv]), lambda k, v: v != "")

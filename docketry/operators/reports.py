"""Reports on files: identity, manifest, history, downloads, and the line that sums them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.scrub import under_evidence
from docketry.runtime import salted_join


def identity(files: DataFrame, *, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Files with extension (lower case, with its dot, empty if none), source_id and under_evidence."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))
    return files.withColumns({"extension": ext, "source_id": F.left(digest, F.lit(16)), "under_evidence": under_evidence(F.col(path))})


def last_recorded(lines: DataFrame, *, path: str = "path", digest: str = "sha256", order: str = "line_no") -> DataFrame:
    """(path, digest) of a manifest read as a map: of a path that stands in several lines the last holds."""
    return lines.where(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(digest, order).alias(digest))


def manifest_section(files: DataFrame, manifest: DataFrame, *, path: str = "path", digest: str = "sha256", applies: str = "under_evidence") -> DataFrame:
    """Add recorded_sha256 and matches: null where the manifest does not apply to the file or does not name it. Manifest paths are unique."""
    known = manifest.select(path, F.col(digest).alias("_r"))
    out = files.join(known, path, "left")
    recorded = F.when(F.col(applies), F.col("_r"))
    return out.withColumns({"recorded_sha256": recorded, "matches": F.when(recorded.isNotNull(), recorded == F.coalesce(digest, F.lit("")))}).drop("_r")


def change_counts(trail: DataFrame, *, path: str, change: str = "change_type") -> DataFrame:
    """(path, commits, content_changes) of a change trail."""
    return trail.groupBy(path).agg(F.count("*").alias("commits"), F.count_if(F.col(change) == "content").alias("content_changes"))


def download_section(files: DataFrame, snapshots: DataFrame, *, path: str = "path", live: str = "live_present") -> DataFrame:
    """Add snapshot_count and no_metadata: whether neither the file nor a snapshot tells where it came from. ``snapshots`` has one row for each snapshot with metadata."""
    counts = snapshots.groupBy(path).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return files.join(counts, path, "left").withColumns({"snapshot_count": n, "no_metadata": ~F.coalesce(F.col(live), F.lit(False)) & (n == 0)}).drop("_n")


def verdict_line(*, commits: Column, content_changes: Column, evidence: Column, applies: Column, matches: Column, live: Column, snapshots: Column) -> Column:
    """One line on a file: its history, its manifest entry, its download metadata."""
    # The wording of the line.
    n, c, k = commits.cast("string"), content_changes.cast("string"), snapshots.cast("string")
    git = (
        F.when(commits == 0, "git: ⚠ untracked")
        .when(evidence & (content_changes > 0), F.concat(F.lit("git: ⚠ "), c, F.lit(" content edit(s)")))
        .when(evidence & (commits == 1), "git: add-only ✓")
        .when(evidence, F.concat(F.lit("git: "), n, F.lit(" commits (renames only) ✓")))
        .otherwise(F.concat(F.lit("git: "), n, F.lit(" commit(s)")))
    )
    held = F.when(applies, F.when(matches, "hash: matches manifest ✓").when(~matches, "hash: ⚠ MISMATCH").otherwise("hash: ⚠ not in manifest"))
    seen = (
        F.when(live & (snapshots > 0), F.concat(F.lit("xattr: live + "), k, F.lit(" snapshot(s) ✓")))
        .when(snapshots > 0, F.concat(F.lit("xattr: snapshot-only ("), k, F.lit(")")))
        .when(live, "xattr: live-only (not yet snapshotted)")
        .otherwise("xattr: none")
    )
    return F.concat_ws("; ", git, held, seen)


def file_report(files: DataFrame, *, manifest: DataFrame, trail: DataFrame, snapshots: DataFrame, path: str = "path", live: str = "live_present") -> DataFrame:
    """One row a file: identity, manifest, history and download sections, warnings, and the verdict line.

    All sections are joined by path, which is unique in ``files`` and ``manifest``; histories and snapshots
    are counted before they are joined.
    """
    out = manifest_section(identity(files, path=path), manifest, path=path)
    out = download_section(out, snapshots, path=path, live=live).join(change_counts(trail, path=path), path, "left")
    out = out.na.fill(0, ["commits", "content_changes"])
    applies = F.col("under_evidence")
    warnings = F.array(
        F.when(F.col("commits") == 0, "no history"), F.when(applies & (F.col("content_changes") > 0), "content changed"), F.when(applies & ~F.col("matches"), "HASH MISMATCH"),
        F.when(applies & F.col("matches").isNull(), "not in manifest"), F.when(F.col("no_metadata"), "no download metadata"),
    )
    line = verdict_line(commits=F.col("commits"), content_changes=F.col("content_changes"), evidence=applies, applies=applies, matches=F.col("matches"), live=F.coalesce(F.col(live), F.lit(False)), snapshots=F.col("snapshot_count"))
    return out.withColumns({"warnings": F.filter(warnings, lambda w: w.isNotNull()), "line": line})


def scrub_summary(changes: DataFrame, file: str) -> DataFrame:
    """(files, changes): how many files a scrub changed, and how often."""
    return changes.agg(F.count_distinct(file).alias("files"), F.count("*").alias("changes"))


def kind_counts(rows: DataFrame, kinds: list[str], *, unknown: str = "unknown", total: str = "(all)") -> DataFrame:
    """(kind, n) by the first column of ``kinds`` that is filled, with one row for all."""
    kind = F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k in kinds], F.lit(unknown))
    return rows.select(kind.alias("kind")).rollup("kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("_g")).select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col("kind")).alias("kind"), "n")


def with_external(entries: DataFrame, external: DataFrame, *, name: str) -> DataFrame:
    """Scanned entries and those of other manifests, none dropped as repeated; ``source_manifest`` and ``kind`` are filled where they are missing."""
    cols = external.columns
    named = F.coalesce("source_manifest", F.lit(name)) if "source_manifest" in cols else F.lit(name)
    kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")) if "kind" in cols else F.lit(None).cast("string"), F.lit("unknown"))
    return entries.unionByName(external.withColumns({"source_manifest": named, "kind": kind}), allowMissingColumns=True)


def recorded_inputs(inputs: DataFrame, *, widget: list[str], path: str = "path", digest: str | None = None) -> DataFrame:
    """One row a widget: its sorted different inputs, joined by commas, and their number; with ``digest`` each as ``path=digest``."""
    item = F.col(path) if digest is None else F.concat(path, F.lit("="), F.coalesce(digest, F.lit("")))
    return inputs.groupBy(*widget).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("paths"), F.count_distinct(path).alias("n"))


def basename_history(entries: DataFrame, *, scope: str, path: str, number: str, key: str) -> DataFrame:
    """(key, seen): how many rows of earlier snapshots of the scope have the same file name, in whatever folder.

    Rows are counted by name and snapshot first, and the counts joined back over salts, so a name that a
    third of all rows bear is no task of its own.
    """
    from pyspark.sql import Window

    s = entries.select(key, F.col(scope).alias("_s"), F.col(number).alias("_n"), F.element_at(F.split(path, "/"), -1).alias("_name"))
    per = s.groupBy("_s", "_name", "_n").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_s", "_name").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("seen", F.sum("n").over(w)).where(F.col("seen") > 0).drop("n")
    return salted_join(s, per, ["_s", "_name", "_n"], salt_on=F.col(key)).select(key, "seen")


def garbled_pages(pages: DataFrame, *, doc: str, number: str = "page_number", text: str = "text", garbled: str = "garbled") -> DataFrame:
    """One row a document: number and list of its garbled pages, whether there is any, and whether any page has text."""
    listed = F.array_sort(F.collect_list(F.when(F.col(garbled), F.col(number))))
    filled = F.regexp_replace(text, r"(?U)^\s+|\s+$", "") != ""
    return pages.groupBy(doc).agg(F.count_if(garbled).alias("garbled_pages"), F.array_join(listed, ",").alias("page_list"), F.coalesce(F.bool_or(garbled), F.lit(False)).alias("any_garbled"), F.coalesce(F.bool_or(filled), F.lit(False)).alias("has_text"))


def recipe(*, source_id: Column, sha256: Column, text: Column, method: Column) -> Column:
    """What is needed to repeat an extraction and check it, as JSON: source, its hash, method, length of the text."""
    return F.to_json(F.struct(source_id.alias("source_id"), sha256.alias("expected_sha256"), method.alias("method"), F.length(F.coalesce(text, F.lit(""))).alias("text_length")))


def replayed(recipe_: Column, *, sha256: Column, text: Column) -> Column:
    """same, source-changed or text-changed of an extraction repeated by its recipe."""
    r = F.from_json(recipe_, "expected_sha256 string, text_length int")
    return F.when(~r.expected_sha256.eqNullSafe(sha256), "source-changed").when(r.text_length != F.length(F.coalesce(text, F.lit(""))), "text-changed").otherwise("same")

"""Lookups against small rule tables and sibling files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.runtime import checked_join, rank_in_group


def sibling(path: Column, layer: str, suffix: str | None = None) -> Column:
    """The same path in another layer: the first part named raw, readable, structured or human is swapped; ``suffix`` replaces the last one."""
    moved = F.regexp_replace(path, r"^((?:[^/]*/)*?)(?:raw|readable|structured|human)(?=/|$)", f"$1{layer}")
    return F.regexp_replace(moved, r"\.[^./]*$", suffix) if suffix else moved


def under(path: Column, protected: list[str]) -> Column:
    """Whether a path is one of ``protected`` or below one."""
    hit = F.lit(False)
    for p in protected:
        hit = hit | (path == p.rstrip("/")) | F.startswith(path, F.lit(p.rstrip("/") + "/"))
    return hit


def role_of(author: Column, initials: Column, rules: list[dict], default: str) -> Column:
    """Role of the first rule whose keys (author, initials) all equal; rules without a key are passed over."""
    cases = []
    for r in rules:
        keys = [c == r[k] for k, c in (("author", author), ("initials", initials)) if r.get(k)]
        if keys:
            hold = keys[0]
            for k in keys[1:]:
                hold = hold & k
            cases.append(F.when(hold, F.lit(r["role"])))
    return F.coalesce(*cases, F.lit(default))


def with_fallback(df: DataFrame, directory: DataFrame, *, on: str, scope: str, value: str, any_scope: str = "*") -> DataFrame:
    """Add ``value`` of the directory's row for (on, scope), else of its row for (on, any_scope). Directory keys are unique; large directories are salted by the row's own values."""
    salt = F.struct(*df.columns)
    exact = directory.select(on, scope, F.col(value).alias("_exact"))
    rest = directory.where(F.col(scope) == any_scope).select(on, F.col(value).alias("_any"))
    out = checked_join(df, exact, [on, scope], "left", salt_on=salt)
    out = checked_join(out, rest, [on], "left", salt_on=salt)
    return out.withColumn(value, F.coalesce("_exact", "_any")).drop("_exact", "_any")


def fuzzy_name(raw: Column, table: list[str]) -> Column:
    """The table's name that equals the input without case, else the first of which one begins with the other, else the input as it is."""
    low = F.lower(F.trim(raw))
    exact = [F.when(low == t.lower(), F.lit(t)) for t in table]
    prefix = [F.when((low != "") & (F.startswith(low, F.lit(t.lower())) | F.startswith(F.lit(t.lower()), low)), F.lit(t)) for t in table]
    return F.coalesce(*exact, *prefix, raw)


def conflicts(pairs: DataFrame, fields: list[str], *, left: str = "local_", right: str = "web_") -> Column:
    """Names of the fields that both sides fill, and fill differently, joined by commas."""
    differ = [F.when((F.col(left + f) != "") & (F.col(right + f) != "") & (F.col(left + f) != F.col(right + f)), F.lit(f)) for f in fields]
    return F.array_join(F.filter(F.array(*differ), lambda x: x.isNotNull()), ",")


def unique_slugs(df: DataFrame, slug: str, order: list[str], out: str = "unique_slug") -> DataFrame:
    """Add the slug with -2, -3 and so on from its second use on, in the order given; null stays null."""
    numbered = rank_in_group(df, [slug], order, "_use")
    name = F.when(F.col("_use") > 1, F.concat(slug, F.lit("-"), F.col("_use").cast("string"))).otherwise(F.col(slug))
    return numbered.select(*df.columns, name.alias(out))


def snippet(text: Column, length: int = 80) -> Column:
    """The first characters of a text with all white space flat."""
    return F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(length))


def first_paragraph(text: Column, length: int = 400) -> Column:
    """The first paragraph that is no heading, flat and cut."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: (F.trim(p) != "") & ~F.startswith(F.ltrim(p), F.lit("#")))
    return snippet(F.get(parts, F.lit(0)), length)


def capped(lines: Column, limit: int = 500) -> Column:
    """Struct of the first lines and whether there were more: the form of a report, not of a result set."""
    return F.struct(F.slice(lines, 1, limit).alias("lines"), (F.size(lines) > limit).alias("truncated"))


def changed_files(renames: DataFrame) -> DataFrame:
    """(status, path) of staged changes; a rename is a deletion and an addition."""
    two = F.array(F.struct(F.lit("D").alias("status"), F.col("old_path").alias("path")), F.struct(F.lit("A").alias("status"), F.col("path").alias("path")))
    one = F.array(F.struct(F.col("status").alias("status"), F.col("path").alias("path")))
    return renames.select(F.explode(F.when(F.startswith("status", F.lit("R")), two).otherwise(one)).alias("c")).select("c.*")

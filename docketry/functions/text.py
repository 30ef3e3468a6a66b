"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Null where a string is null or empty: the engine treats both as missing."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slug(c: Column, *, length: int = 40, default: str = "msg") -> Column:
    """Runs outside letters, digits, dot, underscore and hyphen to one hyphen, none at the ends."""
    return F.left(F.coalesce(filled(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")), F.lit(default)), F.lit(length))


def citation_slug(c: Column, *, length: int = 60) -> Column:
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(length))
    return F.coalesce(filled(F.regexp_replace(s, "-+$", "")), F.lit("ref"))


def title_slug(c: Column) -> Column:
    """Letters and digits kept, blanks, hyphens and underscores to hyphens, all else dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\p{L}\p{N} _-]", ""), "[ _-]", "-")


def name_key(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def host(url: Column) -> Column:
    """Lower-case host without leading ``www.``; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def label(i: Column) -> Column:
    """Base-26 label of a position from 0: A..Z, AA..ZZ."""
    letter = lambda n: F.char(n.cast("int") + 65)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tag(text: Column) -> tuple[Column, Column]:
    """Marker such as ``q+f:`` at the beginning: its letters in the order F, Q, A (or S alone), and the rest of the text."""
    raw = F.upper(F.regexp_extract(text, r"(?i)^\s*([FQA](?:\+[FQA])*|S)\s*:\s*", 1))
    letters = F.array(*[F.when(F.contains(raw, F.lit(x)), F.lit(x)) for x in "FQA"])
    tagged = F.when(raw == "S", F.lit("S")).otherwise(F.array_join(F.filter(letters, lambda x: x.isNotNull()), "+"))
    return tagged, F.regexp_replace(text, r"(?i)^\s*(?:[FQA](?:\+[FQA])*|S)\s*:\s*", "")


def content_type(declared: Column, path: Column) -> Column:
    """Declared type without parameters, else by suffix."""
    # Suffix -> content type.
    table = {"html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword"}
    by_suffix = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return F.coalesce(filled(F.trim(F.lower(F.substring_index(declared, ";", 1)))), by_suffix, F.lit("application/octet-stream"))

"""Ordered rule tables compiled to Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, *, cross: bool = False) -> str:
    """A glob as a regular expression. ``cross``: ``*`` also matches ``/``; else ``**`` does and ``**/`` may be empty."""
    out, i = [], 0
    while i < len(pattern):
        rest = pattern[i:]
        if not cross and rest.startswith("**/"):
            out.append("(?:.*/)?")
            i += 3
        elif not cross and rest.startswith("**"):
            out.append(".*")
            i += 2
        elif rest[0] == "*":
            out.append(".*" if cross else "[^/]*")
            i += 1
        elif rest[0] == "?":
            out.append("." if cross else "[^/]")
            i += 1
        elif cross and rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            body = rest[1:end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i += end + 1
        else:
            out.append(re.escape(rest[0]))
            i += 1
    return "^" + "".join(out) + "$"


def first_match(value: Column, rules: list[tuple[str, str]], default: str, *, cross: bool = False) -> Column:
    """Result of the first rule whose glob matches, without regard to case."""
    return F.coalesce(*[F.when(value.rlike("(?is)" + glob_regex(g, cross=cross)), F.lit(r)) for g, r in rules], F.lit(default))


def host_verdict(host: Column, deny: list[tuple[str, str]], allow: list[tuple[str, str]]) -> Column:
    """deny:<reason>, allow:<trust> or unknown: denials come first, the first pattern wins."""
    rules = [(p, f"deny:{r}") for p, r in deny] + [(p, f"allow:{t}") for p, t in allow]
    return F.coalesce(*[F.when(host.rlike("(?is)" + glob_regex(p, cross=True)), F.lit(v)) for p, v in rules], F.lit("unknown"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _party(addresses: Column, wanted: str) -> Column:
    return F.exists(addresses, lambda a: F.endswith(a, F.lit(wanted)) if wanted.startswith("@") else a == wanted)


def message_predicate(cfg: dict, *, addresses: Column, subject: Column, body: Column, headers: Column, day: Column) -> Column:
    """A configuration as one condition: every key given must hold, any of its values is enough; an empty one is true.

    Keys: parties (addresses or @domains), subject, body (patterns), headers ({name: needles}), identifiers,
    since and until (inclusive days; undated messages fall out).
    """
    out = F.lit(True)
    if v := cfg.get("parties"):
        out &= any_of([_party(addresses, p.lower()) for p in v])
    for key, col in (("subject", subject), ("body", body)):
        if v := cfg.get(key):
            out &= F.coalesce(any_of([col.rlike("(?iU)" + p) for p in v]), F.lit(False))
    if v := cfg.get("headers"):
        out &= F.coalesce(any_of([F.contains(F.try_element_at(headers, F.lit(h)), F.lit(n)) for h, needles in v.items() for n in needles]), F.lit(False))
    if v := cfg.get("identifiers"):
        hay = F.concat_ws(" ", subject, body, F.array_join(F.map_values(headers), " "))
        out &= any_of([F.contains(hay, F.lit(i)) for i in v])
    if cfg.get("since") or cfg.get("until"):
        out &= day.isNotNull()
        if cfg.get("since"):
            out &= day >= F.lit(cfg["since"]).cast("date")
        if cfg.get("until"):
            out &= day <= F.lit(cfg["until"]).cast("date")
    return F.coalesce(out, F.lit(False))

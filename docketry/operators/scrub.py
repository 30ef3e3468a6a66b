"""Scrubbing of known terms and well-formed identifiers, with a record of every change."""

from __future__ import annotations

import bisect
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Detectors and placeholders.
DETECTORS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]?\d{4}(?!\d)"),
    ("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
    ("address", r"\b\d{1,6}\s+(?:[A-Z][A-Za-z0-9.'-]*\s+){1,5}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Terrace|Ter|Place|Pl|Way|Parkway|Pkwy|Highway|Hwy|Circle|Cir)\b\.?"),
)
PLACEHOLDERS = {"email": "redacted@example.invalid", "phone": "555-000-0000", "vin": "VIN-REDACTED-0000", "policy_number": "POLICY-REDACTED", "address": "[ADDRESS REDACTED]"}
_CHANGES = "array<struct<line:int,detector:string,original_sha256:string,replacement:string>>"


def scrub_one(text: str, mapping: dict[str, str], policies: list[str], strict_digits: bool = False) -> tuple[str, list[tuple]]:
    """Passes in turn: known terms (longest first, one scan), then policy patterns, then detectors. Line numbers are those of the text as each pass finds it."""
    detectors = [("policy_number", p) for p in policies] + list(DETECTORS)
    if strict_digits:
        detectors.insert(len(policies) + 1, ("phone", r"(?<!\d)(?:\+?1)?\d{10}(?!\d)"))
    passes = [("substitution", "|".join(re.escape(k) for k in sorted(filter(None, mapping), key=len, reverse=True)))] if any(mapping) else []
    changes: list[tuple] = []
    for detector, pattern in passes + detectors:
        breaks = [m.start() for m in re.finditer("\n", text)]

        def put(m, detector=detector, breaks=breaks):
            old = m[0]
            if detector != "substitution" and old in mapping:
                return old
            new = mapping[old] if detector == "substitution" else PLACEHOLDERS[detector]
            changes.append((bisect.bisect_left(breaks, m.start()) + 1, detector, hashlib.sha256(old.encode()).hexdigest(), new))
            return new

        text = re.sub(pattern, put, text)
    return text, changes


def scrub(df: DataFrame, text: str, *, mapping: dict[str, str] | None = None, policies: list[str] | None = None, strict_digits: bool = False) -> DataFrame:
    """Add ``scrubbed`` and ``changes``. The terms are a parameter, as large as its writer makes it. Null stays null."""
    terms, patterns = dict(mapping or {}), list(policies or [])

    def run(texts: pd.Series) -> pd.DataFrame:
        out = [scrub_one(t, terms, patterns, strict_digits) if isinstance(t, str) else (None, []) for t in texts]
        return pd.DataFrame({"scrubbed": [t for t, _ in out], "changes": [[dict(zip(("line", "detector", "original_sha256", "replacement"), c)) for c in cs] for _, cs in out]})

    both = F.pandas_udf(run, f"scrubbed string, changes {_CHANGES}")
    return df.withColumn("_s", both(F.col(text))).select(*df.columns, "_s.scrubbed", "_s.changes")


def scrub_report(scrubbed: DataFrame, key: str) -> DataFrame:
    """One row per change: (key, line, detector, original_sha256, replacement)."""
    return scrubbed.select(key, F.explode("changes").alias("c")).select(key, "c.*")


def survivors(text: Column, terms: list[str]) -> Column:
    """Banned terms still in a text, as an array in the order given."""
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms if t]), lambda x: x.isNotNull())


def banned_terms(mapping: dict[str, str], extra: list[str]) -> list[str]:
    return sorted({t for t in [*mapping, *extra] if t}, key=lambda t: (-len(t), t))


def under_evidence(path: Column) -> Column:
    """Whether any part of a path is ``evidence``; such files are never rewritten."""
    return F.array_contains(F.split(path, "/"), "evidence")

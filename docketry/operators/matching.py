"""Lookups by rule and greedy one-to-one matching."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_scores(df: DataFrame, text: str, rules: list[tuple[str, list[str]]], *, bonus=None) -> DataFrame:
    """Add ``best`` and ``score``: one point per keyword found, ``bonus(slug)`` on top; ties go to the earlier rule, no point to 'unknown'. The rules are a parameter and become one expression."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for i, (slug, words) in enumerate(rules):
        s = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
        scored.append(F.struct((s + bonus(slug) if bonus else s).alias("score"), F.lit(-i).alias("order"), F.lit(slug).alias("slug")))
    top = F.array_max(F.array(*scored))
    return df.withColumn("_top", top).select(*df.columns, F.when(F.col("_top.score") > 0, F.col("_top.slug")).otherwise("unknown").alias("best"), F.col("_top.score").alias("score"))


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def greedy_match(local: DataFrame, web: DataFrame, *, group: list[str], name: str, order: str, threshold: float = 0.82) -> DataFrame:
    """(group..., local_name, web_name) of a greedy one-to-one matching in list order: equal keys first, else a Ratcliff-Obershelp ratio from ``threshold`` on.

    The assignment is sequential inside a group by its definition. Rows first meet in a cogroup of the
    group columns; choose them so that a group is a list one would match by hand.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = list(right.sort_values(order)[name])
        rows = []
        keep = [left[c].iloc[0] if len(left) else None for c in group]
        norm = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
        for n in left.sort_values(order)[name]:
            hit = next((w for w in free if norm(w) == norm(n) or ratio(norm(n), norm(w)) >= threshold), None)
            if hit is not None:
                free.remove(hit)
            rows.append((*keep, n, hit))
        return pd.DataFrame(rows, columns=[*group, "local_name", "web_name"])

    kinds = dict(local.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in group] + ["local_name string", "web_name string"])
    return local.groupBy(*group).cogroup(web.groupBy(*group)).applyInPandas(match, schema)

"""Threads of comments or messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.runtime import materialize


def thread_roots(edges: DataFrame, *, node: str, parent: str) -> DataFrame:
    """(node, root) by pointer doubling: chains of up to n nodes take log2(n) joins.

    Null and empty parents end a chain; an unknown parent is the root. Nodes on a cycle, or leading into
    one, take the cycle's smallest node. A repeated node keeps its smallest parent.
    """
    kind = dict(edges.dtypes)[node]
    up = edges.groupBy(F.col(node).alias("node")).agg(F.min(F.nullif(F.col(parent).cast("string"), F.lit("")).cast(kind)).alias("up"))
    first = up.select("node", F.coalesce("up", "node").alias("to"), F.least("node", "up").alias("low"), (F.col("up").isNull() | (F.col("up") == F.col("node"))).alias("own"))
    ptr = materialize(first)
    for _ in range(max(1, ptr.count()).bit_length() + 1):
        nxt = ptr.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        step = ptr.join(nxt, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), F.least("low", "low2").alias("low"), "own", (F.coalesce("to2", "to") != F.col("to")).alias("moved"))
        step = materialize(step)
        ptr = step.drop("moved")
        if not step.where("moved").head(1):
            break
    ends = ptr.select(F.col("node").alias("to"), F.col("low").alias("low2"), F.col("own").alias("own2"))
    return ptr.join(ends, "to", "left").select("node", F.when(F.coalesce("own2", F.lit(True)), F.col("to")).otherwise(F.col("low2")).alias("root"))


def thread_catalog(comments: DataFrame, *, root: str, order: list[str], author: str, text: str, me: str, skip: str = "[skip — ", substantive: int = 80) -> DataFrame:
    """One row per thread: first and last comment, number, last_author, needs_reply, prior_reply_id.

    ``order`` ends with the comment's id. A thread needs a reply if its last comment is neither mine nor
    marked to be skipped; prior_reply_id is my latest earlier comment of at least ``substantive``
    characters. All of it is one map-side-combined aggregate; no thread is gathered.
    """
    key, ident = F.struct(*order), F.col(order[-1])
    skipped = F.startswith(F.ltrim(F.coalesce(text, F.lit(""))), F.lit(skip))
    mine = (F.col(author) == me) & ~skipped & (F.length(text) >= substantive)
    agg = comments.groupBy(F.col(root).alias("root_id")).agg(
        F.min_by(ident, key).alias("first_id"), F.max_by(ident, key).alias("last_id"), F.count("*").alias("n_comments"), F.max_by(author, key).alias("last_author"),
        F.max_by(skipped, key).alias("_skip"), F.max(key).alias("_last"), F.max(F.when(mine, key)).alias("_mine"),
    )
    reply = ~F.coalesce(F.col("last_author") == me, F.lit(False)) & ~F.col("_skip")
    return agg.select("root_id", "first_id", "last_id", "n_comments", "last_author", reply.alias("needs_reply"), F.when(reply, F.col("_mine")[order[-1]]).alias("prior_reply_id"))


def message_root(subject: Column) -> Column:
    """Subject without reply and forward marks, lower case: the key of a conversation."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), r"^(?:\s*(?:re|fwd?|aw)\s*:\s*)+", ""))

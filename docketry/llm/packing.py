"""Filling containers of fixed capacity with documents, through optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import materialize, prefix_sums

#: Length buckets for each capacity.
BUCKETS = 64


def bucket_bounds(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """Upper bounds of at most ``k`` buckets over a length histogram with the least total padding.

    Dynamic programming over the sorted lengths. The best split moves to the right with the end of the
    range, so each layer is solved by halving: O(k m log m) for m different lengths.
    """
    x, n = np.asarray(lengths, float), np.asarray(counts, float)
    m = len(x)
    if m <= k:
        return [int(v) for v in lengths]
    c, s = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(n * x)))
    best = x * c[1:] - s[1:]  # one bucket over the first j+1 lengths
    back = []
    for _ in range(1, k):
        new, cut = np.full(m, np.inf), np.zeros(m, int)
        stack = [(0, m - 1, 0, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)  # the last bucket starts at length i
            before = np.where(i > 0, best[i - 1], 0.0)
            cost = before + x[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
            t = int(np.argmin(cost))
            new[j], cut[j] = cost[t], i[t]
            stack.append((lo, j - 1, a, int(i[t])))
            stack.append((j + 1, hi, int(i[t]), b))
        best = new
        back.append(cut)
    bounds, j = [], m - 1
    for cut in reversed(back):
        bounds.append(int(x[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(x[j]))
    return sorted(set(bounds))


def batch_patterns(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How containers are filled from buckets: (number of containers, items taken of each bucket).

    From the longest bucket down, a batch takes as many items of its own bucket as the token budget
    holds at the bucket's bound; what is left of the budget is topped up from shorter buckets. A pattern
    is repeated as long as its buckets last, so the list has a few entries per bucket, however many
    documents there are.
    """
    left, out = list(counts), []
    for k in range(len(bounds) - 1, -1, -1):
        while left[k] > 0:
            room, take = capacity, {}
            for j in range(k, -1, -1):
                if left[j] > 0 and (n := min(room // bounds[j], left[j])) > 0:
                    take[j] = n
                    room -= n * bounds[j]
            times = min(left[j] // n for j, n in take.items())
            for j, n in take.items():
                left[j] -= n * times
            out.append((times, take))
    return out


def pack(sizes: DataFrame, containers: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """The container of every document for each capacity: (container_kind, key, piece_no, container_no, tokens).

    A document over the capacity is divided into pieces that fill a container each, and a rest that is
    packed as the other documents are; no other document is divided. Empty documents take the room of
    one token. ``containers`` (container_kind, capacity_tokens) is a parameter table.

    The histogram of lengths comes from one map-side-combined aggregate and has at most
    ``capacity_tokens`` rows a kind; bucket bounds and patterns are worked out from it. Documents get
    their container from their rank in the bucket, which is a two-level prefix sum, so no bucket is ever
    read by one task. Null kinds or capacities below 1 are left out; tables may be empty.
    """
    kinds = containers.where(F.col("container_kind").isNotNull() & (F.col("capacity_tokens") >= 1)).select("container_kind", F.col("capacity_tokens").cast("long").alias("cap"))
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(1))
    caps = {r.container_kind: r.cap for r in kinds.collect()}
    choice = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("cap")) for k, c in sorted(caps.items())])
    if not caps:
        return spark.createDataFrame([], f"container_kind string, {key} bigint, piece_no int, container_no bigint, tokens bigint")
    items = sizes.select(F.col(key), n.alias("n"), F.explode(choice).alias("c")).select(key, "c.*", "n")
    items = materialize(items.withColumn("full", F.floor(F.col("n") / F.col("cap"))).withColumn("rest", F.col("n") % F.col("cap")))
    hist: dict[str, list[tuple[int, int]]] = {k: [] for k in caps}
    for r in items.where(F.col("rest") > 0).groupBy("container_kind", "rest").count().collect():
        hist[r.container_kind].append((r.rest, r["count"]))
    bound_rows, slot_rows, packed = [], [], {}
    for kind, pairs in hist.items():
        pairs.sort()
        bounds = bucket_bounds([a for a, _ in pairs], [b for _, b in pairs], buckets) if pairs else []
        counts = [0] * len(bounds)
        for length, count in pairs:
            counts[int(np.searchsorted(bounds, length))] += count
        base, used = 0, [0] * len(bounds)
        slots: dict[int, list] = {}
        for times, take in batch_patterns(bounds, counts, caps[kind]):
            for j, per in take.items():
                slots.setdefault(j, []).append((used[j], used[j] + per * times, base, per))
                used[j] += per * times
            base += times
        packed[kind] = base
        bound_rows.append((kind, bounds))
        slot_rows += [(kind, j, v) for j, v in slots.items()]
    bound_table = spark.createDataFrame(bound_rows, "container_kind string, bounds array<bigint>")
    slot_table = spark.createDataFrame(slot_rows, "container_kind string, bucket int, slots array<struct<a:bigint,b:bigint,base:bigint,per:bigint>>")
    whole = F.when(F.col("full") > 0, F.struct(F.lit(-1).alias("bucket"), F.col("full").alias("value")))
    bucket = F.size(F.filter("bounds", lambda b: b < F.col("rest")))
    part = F.when(F.col("rest") > 0, F.struct(bucket.alias("bucket"), F.lit(1).cast("long").alias("value")))
    parts = items.join(F.broadcast(bound_table), "container_kind").withColumn("p", F.explode(F.filter(F.array(whole, part), lambda p: p.isNotNull())))
    parts = parts.select(key, "container_kind", "cap", "full", "rest", "p.bucket", "p.value")
    ranked = prefix_sums(parts, ["container_kind", "bucket"], [key], "value", "rank")
    slot = F.get(F.filter("slots", lambda s: (F.col("rank") >= s.a) & (F.col("rank") < s.b)), F.lit(0))
    small = ranked.where(F.col("bucket") >= 0).join(F.broadcast(slot_table), ["container_kind", "bucket"]).withColumn("s", slot)
    small = small.select("container_kind", key, (F.col("full") + 1).cast("int").alias("piece_no"), (F.col("s.base") + F.floor((F.col("rank") - F.col("s.a")) / F.col("s.per"))).alias("container_no"), F.col("rest").alias("tokens"))
    first = F.create_map(*[F.lit(x) for k, v in packed.items() for x in (k, v)])
    big = ranked.where(F.col("bucket") < 0).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("full").cast("int"))))
    big = big.select("container_kind", key, F.col("i").alias("piece_no"), (first[F.col("container_kind")] + F.col("rank") + F.col("i") - 1).cast("long").alias("container_no"), F.col("cap").alias("tokens"))
    return small.unionByName(big)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers used, tokens held and the share of the capacity that is filled, by kind."""
    per = packed.groupBy("container_kind").agg(F.max("container_no").alias("last"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    per = per.join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind")
    return per.select("container_kind", (F.col("last") + 1).alias("containers"), "pieces", "tokens", F.round(F.col("tokens") / ((F.col("last") + 1) * F.col("capacity_tokens")), 4).alias("filled"))

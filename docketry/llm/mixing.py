"""Mixing sources to target shares, in the order of a curriculum whose weights change over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import materialize, prefix_sums

_SEGMENTS = "array<struct<t0:double,w0:double,slope:double,c0:double,c1:double>>"
PLAN = f"mix_id string, source string, target_share double, demand double, tokens bigint, passes bigint, rest double, segments {_SEGMENTS}"


def segments_of(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """A weight schedule as pieces (t0, w0, slope, c0, c1): linear weights from t0 on, whose integral runs from c0 to c1.

    ``knots`` are (time, weight); weights are linear between them and constant outside, times lie in
    [0, 1], negative weights count as 0. The integral over [0, 1] is scaled to 1; a schedule without any
    weight is constant.
    """
    at = {min(1.0, max(0.0, float(t))): max(0.0, float(w)) for t, w in sorted(knots)}
    points = sorted(at.items()) or [(0.0, 1.0)]
    points = [(0.0, points[0][1])] * (points[0][0] > 0) + points + [(1.0, points[-1][1])] * (points[-1][0] < 1)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    if area <= 0:
        points, area = [(0.0, 1.0), (1.0, 1.0)], 1.0
    out, c = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:]):
        grown = c + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((t0, w0 / area, (w1 - w0) / (t1 - t0) / area, c, grown))
        c = grown
    return out


def tilted(totals: list[tuple[str, int, int]], targets: list[tuple[str, str, float, int]], tilt: float) -> dict[tuple[str, str], list[tuple[float, float]]]:
    """The schedule used where a caller gives none: w(t) = share * (1 + b * (1 - 2 t)), sources of shorter documents earlier; weights add up to the same at every t."""
    mean_size = {s: n / d for s, n, d in totals if n and d}
    out = {}
    for mix in {m for m, *_ in targets}:
        have = sorted(((mean_size[s], s, share) for m, s, share, _ in targets if m == mix and s in mean_size and share and share > 0))
        whole = sum(share for *_, share in have)
        place = {s: 1 - 2 * i / max(1, len(have) - 1) for i, (_, s, _) in enumerate(have)}
        mean = sum(share * place[s] for _, s, share in have) / whole if have else 0.0
        spread = max([abs(place[s] - mean) for _, s, _ in have] + [1.0])
        for _, s, _ in have:
            b = tilt * (place[s] - mean) / spread
            out[mix, s] = [(0.0, 1 + b), (1.0, 1 - b)]
    return out


def plan_mixes(
    totals: list[tuple[str, int, int]], targets: list[tuple[str, str, float, int]], schedules: dict[tuple[str, str], list[tuple[float, float]]], budget: float | None
) -> list[tuple]:
    """Demand, whole passes, the rest and the schedule of every (mix, source); all inputs are a few rows a source.

    The total is ``budget``, or the size of the mix's sources once over, cut to what the capped
    repetitions of every source allow. A source with nothing to give leaves its share to the others in
    proportion to theirs.
    """
    size = {s: n for s, n, _ in totals}
    out = []
    for mix in sorted({m for m, *_ in targets}):
        rows = [(s, share, cap) for m, s, share, cap in targets if m == mix and share and share > 0]
        have = [(s, share, cap) for s, share, cap in rows if size.get(s, 0) > 0 and cap and cap > 0]
        out += [(mix, s, share, 0.0, size.get(s, 0), 0, 0.0, segments_of([])) for s, share, cap in rows if (s, share, cap) not in have]
        if not have:
            continue
        whole = sum(share for _, share, _ in have)
        most = min(size[s] * cap * whole / share for s, share, cap in have)
        total = min(most, budget if budget is not None else sum(size[s] for s, _, _ in have))
        for s, share, cap in have:
            demand = total * share / whole
            passes = min(int(demand // size[s]), cap)
            rest = demand - passes * size[s] if passes < cap else 0.0
            out.append((mix, s, share, demand, size[s], passes, rest, segments_of(schedules.get((mix, s), []))))
    return out


def mix(sizes: DataFrame, targets: DataFrame, *, schedule: DataFrame | None = None, tilt: float = 0.5, budget: float | None = None, seed: int = 0) -> DataFrame:
    """How often each document is used in each mix: (mix_id, source, doc_id, n_tokens, uses, offset, last_offset, target_share, demand, tokens, segments).

    Every source is passed through in a hashed order, whole as often as its demand holds its size. The
    last pass takes the documents that fit one after another, then the one document whose size comes
    nearest to what is left, if it brings the source closer to its demand. Nobody is used more than
    ``max_repeats`` times. Offsets are two-level prefix sums, so that a source holding a third of all
    tokens is spread over many tasks. Documents without source or of sources outside a mix do not appear
    in it; repeated targets are taken once.

    ``schedule``: (mix_id, source, at, weight), the weight of a source over the time of the training, linear
    between the times given; it says when a source is used, the target share says how much of it. Without
    it ``tilt`` leans the sources of shorter documents to the beginning.
    """
    spark = sizes.sparkSession
    wanted = targets.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull()).dropDuplicates(["mix_id", "source"])
    names = wanted.select("source").distinct()
    docs = sizes.where(F.col("doc_id").isNotNull()).join(F.broadcast(names), "source")
    totals = [(r.source, r.n, r.d) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")).collect()]
    rows = [(r.mix_id, r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in wanted.collect()]
    knots: dict[tuple[str, str], list[tuple[float, float]]] = {} if schedule is not None else tilted(totals, rows, tilt)
    for r in schedule.where(F.col("at").isNotNull() & F.col("weight").isNotNull()).collect() if schedule is not None else ():
        knots.setdefault((r.mix_id, r.source), []).append((r["at"], r["weight"]))
    plan = spark.createDataFrame(plan_mixes(totals, rows, knots, budget), PLAN)
    ordered = materialize(prefix_sums(docs, ["source"], ["doc_id"], "n_tokens", "offset", seed=seed).select("source", "doc_id", "n_tokens", "offset"))
    used = ordered.join(F.broadcast(plan.drop("segments")), "source")
    fits = (F.col("rest") > 0) & (F.col("offset") + F.col("n_tokens") <= F.col("rest"))
    # what the fitting documents leave, and the document that fills it best: one row a mix and source
    left = used.groupBy("mix_id", "source").agg(F.coalesce(F.sum(F.when(fits, F.col("n_tokens"))), F.lit(0)).alias("held"), F.max("rest").alias("want"))
    others = used.where((F.col("rest") > 0) & ~fits).join(F.broadcast(left), ["mix_id", "source"])
    off = F.abs(F.col("want") - F.col("held") - F.col("n_tokens"))
    filler = others.where(off < F.col("want") - F.col("held")).groupBy("mix_id", "source").agg(F.min_by("doc_id", F.struct(off, "doc_id")).alias("fill"), F.first("held").alias("held"))
    done = used.join(F.broadcast(filler), ["mix_id", "source"], "left")
    fills = F.coalesce(F.col("doc_id") == F.col("fill"), F.lit(False))
    done = done.withColumn("uses", F.col("passes") + (fits | fills).cast("long")).withColumn("last_offset", F.when(fills, F.col("held")).otherwise(F.col("offset")))
    done = done.join(F.broadcast(plan.select("mix_id", "source", "segments")), ["mix_id", "source"])
    return done.select("mix_id", "source", "doc_id", "n_tokens", "uses", "offset", "last_offset", "target_share", "demand", "tokens", "passes", "segments")


def training_order(used: DataFrame, *, unused: bool = False) -> DataFrame:
    """Every use of a document with its training position in [0, 1], range-sorted by position; with ``unused`` also documents that are not used, without position.

    The position is where the cumulative token demand of the document's source, the integral of its weight
    schedule, reaches the middle of this use: c0 + w0 d + slope d^2 / 2 is solved for d in its piece.
    """
    numbers = F.sequence(F.lit(1), F.greatest(F.col("uses").cast("int"), F.lit(1)))
    uses = used if unused else used.where(F.col("uses") > 0)
    uses = uses.withColumn("use_no", F.explode(numbers)).withColumn("use_no", F.when(F.col("uses") > 0, F.col("use_no")))
    start = F.when(F.col("use_no") > F.col("passes"), F.col("last_offset")).otherwise(F.col("offset"))
    u = ((F.col("use_no") - 1) * F.col("tokens") + start + F.col("n_tokens") / 2) / F.col("demand")
    uses = uses.withColumn("_u", F.least(u, F.lit(1.0)))
    piece = F.element_at(F.filter("segments", lambda s: (s.c0 <= F.col("_u")) & (s.c1 > s.c0)), -1)
    uses = uses.withColumn("_p", F.when(F.col("_u").isNotNull(), piece))
    d = F.col("_u") - F.col("_p.c0")
    root = F.sqrt(F.greatest(F.col("_p.w0") * F.col("_p.w0") + 2 * F.col("_p.slope") * d, F.lit(0.0)))
    t = F.col("_p.t0") + F.coalesce(2 * d / F.nullif(F.col("_p.w0") + root, F.lit(0.0)), F.lit(0.0))
    out = uses.select("mix_id", F.least(t, F.lit(1.0)).alias("position"), "source", "doc_id", "use_no", "uses", "n_tokens")
    return out.repartitionByRange("mix_id", "position", "doc_id").sortWithinPartitions("mix_id", "position", "doc_id", "use_no")


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of the tokens of every source of every mix; sources without documents reach 0."""
    per = used.groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    wanted = targets.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull()).dropDuplicates(["mix_id", "source"]).select("mix_id", "source", "target_share")
    per = wanted.join(F.broadcast(per), ["mix_id", "source"], "left").na.fill(0, ["tokens_used", "most_uses"])
    whole = per.groupBy("mix_id").agg(F.sum("tokens_used").alias("all_tokens"))
    joined = per.join(F.broadcast(whole), "mix_id")
    return joined.select("mix_id", "source", "target_share", "tokens_used", "most_uses", F.round(F.col("tokens_used") / F.nullif(F.col("all_tokens"), F.lit(0)), 6).alias("reached_share"))

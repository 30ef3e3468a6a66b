import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from docketry.llm.mixing import mix, plan_mixes, segments_of, shares, training_order
from docketry.llm.packing import batch_patterns, bucket_bounds, fill_report, pack
from docketry.llm.tokens import encoding, token_count


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), 9))
        counts = [rng.randrange(1, 30) for _ in lengths]
        pad = lambda bs: sum(n * (min(b for b in bs if b >= x) - x) for x, n in zip(lengths, counts))  # noqa: B023, E731
        best = min(pad([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
        assert pad(bucket_bounds(lengths, counts, 3)) == best


def test_patterns_place_everything():
    out = batch_patterns([3, 5, 9], [100, 7, 4], 10)
    assert [sum(t * p.get(j, 0) for t, p in out) for j in range(3)] == [100, 7, 4]
    assert all(sum(n * [3, 5, 9][j] for j, n in p.items()) <= 10 for _, p in out)


def test_every_document_is_packed_once_and_only_long_ones_divided(spark):
    rng = random.Random(2)
    rows = [(i, None if i == 3 else 0 if i == 4 else 100 if i % 3 == 0 else rng.choice([1, 50, 64, 65, 128, 129, 700, rng.randrange(1, 300)])) for i in range(900)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("rank", F.lit(1)).withColumn("bucket", F.lit("x"))
    kinds = spark.createDataFrame([("a", 128), ("b", 512), (None, 4), ("z", 0)], "container_kind string, capacity_tokens int")
    got = pack(sizes, kinds, buckets=16)
    per = {}
    for r in got.collect():
        per.setdefault((r.container_kind, r.container_no), []).append(r.tokens)
    caps = {"a": 128, "b": 512}
    assert all(sum(v) <= caps[k] for (k, _), v in per.items()) and {k for k, _ in per} == {"a", "b"}
    docs = got.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("piece_no").alias("m")).collect()
    size = {i: max(n or 0, 1) for i, n in rows}
    assert len(docs) == 1800 and all(r.t == size[r.doc_id] and r.n == r.m == -(-size[r.doc_id] // caps[r.container_kind]) for r in docs)
    assert all(r.filled > 0.85 for r in fill_report(got, kinds).collect())
    assert pack(sizes.limit(0), kinds).count() == 0 and pack(sizes, kinds.limit(0)).count() == 0


def test_plan_and_shares(spark):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else "mid", 10 + i % 17) for i in range(3000)] + [(9001, None, 5), (9002, "other", 5), (None, "big", 5)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.4, 1), ("m", "small", 0.4, 3), ("m", "mid", 0.2, 2), ("m", "mid", 0.2, 2), ("e", "big", 0.5, 1), ("e", "absent", 0.5, 9)], "mix_id string, source string, target_share double, max_repeats int")
    used = mix(sizes, targets)
    cap = {"big": 1, "small": 3, "mid": 2}
    assert all(r.uses <= cap[r.source] for r in used.where("mix_id = 'm'").collect()) and used.where("mix_id = 'e' and uses = 1 and source = 'big'").count() == 2000
    assert used.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    got = {r.source: r for r in shares(used, targets).where("mix_id = 'm'").collect()}
    assert {(r.source, r.reached_share) for r in shares(used, targets).where("mix_id = 'e'").collect()} == {("big", 1.0), ("absent", 0.0)}
    assert all(abs(r.target_share - r.reached_share) < 0.005 for r in got.values())
    order = training_order(used).collect()
    assert len(order) == used.agg(F.sum("uses")).first()[0] and all(0 <= r.position <= 1 for r in order)
    assert [(r.mix_id, r.position) for r in order] == sorted((r.mix_id, r.position) for r in order)
    assert mix(sizes.limit(0), targets).count() == 0
    assert plan_mixes([("a", 100, 10)], [("m", "a", 1.0, 2)], {}, 150)[0][5:7] == (1, 50.0)


def test_positions_follow_a_schedule_table(spark):
    """The tokens of a source before time t are the integral of its weights, whatever the schedule."""
    rows = [(i, "ab"[i % 2], 3 + i % 5) for i in range(4000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    knots = {"a": [(0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (1.0, 1.0)], "b": [(0.5, 2.0)]}
    schedule = spark.createDataFrame([("m", s, t, w) for s, ks in knots.items() for t, w in ks] + [("m", "a", None, 1.0)], "mix_id string, source string, at double, weight double")
    order = training_order(mix(sizes, targets, schedule=schedule)).collect()
    grid = np.linspace(0, 1, 4001)
    for s, ks in knots.items():
        w = np.interp(grid, *zip(*ks))
        area = np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2)))
        mine = sorted((r.position, r.n_tokens) for r in order if r.source == s)
        whole = sum(n for _, n in mine)
        for t in (0.1, 0.3, 0.5, 0.8):
            assert abs(sum(n for p, n in mine if p <= t) / whole - np.interp(t, grid, area / area[-1])) < 0.005
    assert segments_of([]) == segments_of([(0.3, -1.0)]) == [(0.0, 1.0, 0.0, 0.0, 1.0)]


def test_token_counts(spark):
    texts = ["", None, "Hello, world!", "é" * 1000, "a " * 20_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", token_count(F.col("t")).alias("n")).orderBy("i").collect()
    enc = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert [r.n for r in got] == [len(enc.encode_ordinary(t or "")) for t in texts] and enc.decode(enc.encode_ordinary(texts[2])) == texts[2]

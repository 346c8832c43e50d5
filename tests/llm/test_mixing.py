import random

import numpy as np

from docloom.llm.mixing import blocks_of, mixture, permuted, plan


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 65537):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 1).tolist() != permuted(np.arange(1000), 1000, 2).tolist()


def test_plan():
    weights = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "d": (0.0, 5)}
    got = plan(weights, {"a": 1000, "b": 50, "c": 1000}, 1000)
    assert got["b"] == 100 and got["d"] == 0 and abs(sum(got.values()) - 1000) < 1e-6
    assert abs(got["a"] / got["c"] - 2.5) < 1e-9
    assert sum(plan(weights, {"a": 10, "b": 10}, 1000).values()) == 30


def frame(spark, seed=3, n=400):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["big"] * 6 + ["mid"] * 3 + ["tiny"]), draw.randint(0, 300)) for i in range(n)]
    return rows, spark.createDataFrame(rows + [(None, "big", 5), (n, None, 50), (n + 1, "other", 90), rows[0]], "doc_id bigint, source string, tokens bigint")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 1), ("absent", 0.1, 4), (None, 1.0, 1), ("zero", None, None)]


def test_blocks_tile_every_document(spark):
    rows, df = frame(spark)
    clean = df.where("doc_id is not null and source is not null and tokens > 0").dropDuplicates(["doc_id"])
    parts = blocks_of(clean, 64).collect()
    spans, fill = {}, {}
    for r in parts:
        spans.setdefault(r["doc_id"], []).append((r["begin"], r["begin"] + r["tokens"]))
        fill[r["source"], r["block"]] = fill.get((r["source"], r["block"]), 0) + r["tokens"]
    for r in clean.collect():
        own = sorted(spans[r["doc_id"]])
        assert own[0][0] == 0 and own[-1][1] == r["tokens"] and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    last = {s: max(b for t, b in fill if t == s) for s, _ in fill}
    assert all(n == 64 for (s, b), n in fill.items() if b < last[s])


def test_shares_repeats_and_report(spark):
    _, df = frame(spark)
    targets = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int")
    rows, report = mixture(df, targets, block=64, slots=64)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "mid", "tiny", "absent", "zero"}
    assert got["absent"]["share"] == 0 and not got["absent"]["met"] and not got["tiny"]["met"]
    assert abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    out = rows.collect()
    seen = {}
    for r in out:
        seen[r["source"], r["doc_id"], r["begin"]] = seen.get((r["source"], r["doc_id"], r["begin"]), 0) + 1
    limits = {"big": 1, "mid": 2, "tiny": 1}
    assert all(n <= limits[k[0]] for k, n in seen.items())
    assert all(r["repeats"] <= limits.get(s, 0) for s, r in got.items())
    slots = {(r["shard"], r["slot"]) for r in out}
    wanted = round(sum(r["available_tokens"] for r in got.values()) / 64)
    assert len(slots) <= wanted and len(slots) >= wanted * 0.95
    again, _ = mixture(df, targets, block=64, slots=64)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_share_of_a_large_source_is_its_weight(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 100) for i in range(2000)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, weight double, max_repeats int")
    got = {r["source"]: r["share"] for r in mixture(df, targets, total_tokens=100_000, block=50, slots=500)[1].collect()}
    assert abs(got["a"] - 0.7) < 0.03


def test_empty(spark):
    _, df = frame(spark)
    targets = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int")
    rows, report = mixture(df.limit(0), targets)
    assert rows.count() == 0 and report.count() == 5
    assert mixture(df, targets.limit(0))[0].count() == 0


def test_slots_are_never_broadcast(spark):
    sizes = spark.range(200_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "2000L AS tokens")
    targets = spark.createDataFrame([("s0", 0.5, 2), ("s1", 0.3, 1), ("s2", 0.2, 1)], "source string, weight double, max_repeats int")
    rows, _ = mixture(sizes, targets)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    slots = [line for line in plan.split("\n") if "slot_rows" in line]
    above = plan.split("slot_rows")[0]
    assert slots and "BroadcastHashJoin" not in above and "BroadcastExchange" not in above


def test_draws_beyond_every_repeat_are_left_out(spark):
    sizes = spark.createDataFrame([("a", "x", 900), ("b", "y", 700), ("c", "y", 2000)], "doc_id string, source string, tokens bigint")
    targets = spark.createDataFrame([("x", 0.7, 1), ("y", 0.3, 1)], "source string, weight double, max_repeats int")
    rows, report = mixture(sizes, targets, total_tokens=100_000, block=16)
    got = {r["source"]: r for r in report.collect()}
    assert 800 <= got["x"]["drawn_tokens"] <= 900 and 2500 <= got["y"]["drawn_tokens"] <= 2700
    assert got["x"]["repeats"] == got["y"]["repeats"] == 1 and not got["x"]["met"]

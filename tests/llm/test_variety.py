import math
import random

import numpy as np

from docloom.llm.variety import greedy, varied_subset


def test_greedy_gains_are_the_growth_of_the_determinant():
    draw = np.random.default_rng(1)
    v = draw.standard_normal((40, 12)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at, gains = greedy(v, 10)
    kernel = np.maximum(v @ v.T, 0).astype(np.float64) ** 2
    for k in range(1, 11):
        assert np.isclose(np.linalg.det(kernel[np.ix_(at[:k], at[:k])]), np.prod(gains[:k]), rtol=1e-3)
    # Each step takes the row with the largest determinant.
    for k in range(1, 10):
        best = max(np.linalg.det(kernel[np.ix_([*at[:k], j], [*at[:k], j])]) for j in range(40) if j not in at[:k])
        assert np.isclose(best, np.prod(gains[: k + 1]), rtol=1e-3)


def test_copies_give_nothing():
    v = np.eye(3, dtype=np.float32)[[0, 0, 0, 1, 1, 2]]
    at, _ = greedy(v, 6)
    assert at.tolist() == [0, 3, 5]


SCHEMA = "id string, question string, difficulty string, task string, rank int"


def rows_of():
    draw = random.Random(4)
    rows = [(f"hot{i:04d}", f"how high is the recall of unit {i % 3} in the same old run", "simple", "qa", 1) for i in range(400)]
    rows += [(f"var{i:04d}", " ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(8)), draw.choice(["complex", "expert", "Simple "]), draw.choice(["qa", "react"]), 1) for i in range(300)]
    return rows


def test_big_groups_do_not_dominate(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    out = varied_subset(df, 40).collect()
    assert len(out) == 40 == len({r["id"] for r in out}) and [r["rank"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 41))
    assert sum(r["id"].startswith("hot") for r in out) <= 5
    assert {"simple", "complex", "expert"} <= {r["difficulty"] for r in out}


def test_parts_give_core_sets(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    out = varied_subset(df, 30, part=100, core=40).collect()
    assert len(out) == 30 and sum(r["id"].startswith("hot") for r in out) <= 5
    again = varied_subset(df.repartition(9), 30, part=100, core=40).collect()
    assert {r["id"] for r in out} == {r["id"] for r in again}


def test_copies_split_over_parts_do_not_come_out(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(f"{c}{i:03d}", t, "simple", "qa", 1) for i, t in enumerate(texts) for c in "abcdef"], SCHEMA)
    out = varied_subset(df, 150, part=200, core=20).collect()
    assert len(out) == 150 == len({texts[int(r["id"][1:])] for r in out})
    # The determinant is nearly that of one greedy pass over all rows.
    whole = varied_subset(df, 150, part=10_000).collect()
    assert sum(np.log(r["gain"]) for r in out) >= sum(np.log(r["gain"]) for r in whole) - 1


def test_nulls_repeats_and_empty(spark):
    rows = [("a", None, None, None, 1), ("a", None, None, None, 1), ("b", "", "x", None, 1), (None, "q", "x", "y", 1), ("c", "word " * 50_000, None, "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = varied_subset(df, 10).collect()
    assert sorted(r["id"] for r in out) == ["a", "b", "c"]
    assert varied_subset(df.limit(0)).count() == 0


def test_parts_lose_little_of_the_determinant(spark):
    """Core-sets of four parts against one greedy pass over all rows: the mean logarithm of the gains."""
    draw = random.Random(11)
    rows = [(f"r{i:04d}", " ".join(f"w{int(draw.random() ** 2 * 300)}" for _ in range(9)), ["easy", "hard"][i % 2], f"t{i % 5}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, question string, difficulty string, task string")
    whole = [r["gain"] for r in varied_subset(df, 40, part=5000).collect()]
    parts = [r["gain"] for r in varied_subset(df, 40, part=200, core=40).collect()]
    assert len(whole) == len(parts) == 40
    assert sum(map(math.log, parts)) / 40 >= sum(map(math.log, whole)) / 40 - 0.02

import pytest

from docloom.llm.sampling import DIFFICULTY_TREE, allocate, category_sample, rounded, wanted_rows

SCHEMA = "id string, difficulty string, category string, key int"


def test_rounded_sums_up():
    assert sum(rounded({"a": 1, "b": 1, "c": 1}, 100).values()) == 100
    assert rounded({"a": 0}, 5) == {"a": 0}


def test_minimum_is_paid_by_the_largest():
    got = wanted_rows({"a": (0.9, 1), "b": (0.1, 20)}, {"a": 500, "b": 15}, 100)
    assert got == {"a": 85, "b": 15}


def test_unmet_quota_goes_to_siblings_then_cousins():
    tree = {"a": ("x", "l"), "b": ("x", "l"), "c": ("x", "m"), "d": ("y", "n")}
    want = {"a": 10, "b": 10, "c": 10, "d": 10}
    assert allocate(want, {"a": 2, "b": 100, "c": 100, "d": 100}, tree) == {"a": 2, "b": 18, "c": 10, "d": 10}
    assert allocate(want, {"a": 2, "b": 5, "c": 100, "d": 100}, tree) == {"a": 2, "b": 5, "c": 23, "d": 10}
    assert allocate(want, {"a": 2, "b": 5, "c": 6, "d": 100}, tree) == {"a": 2, "b": 5, "c": 6, "d": 27}
    assert sum(allocate(want, {"a": 1}, tree).values()) == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_frame(spark, parts):
    rows = [(f"s{i}", ["simple", " Simple", "SIMPLE."][i % 3], "x", 0) for i in range(900)] + [(f"i{i}", "intermediate", None, 0) for i in range(300)] + [(f"e{i}", "expert", None, 0) for i in range(4)]
    rows += [("n1", None, None, 0), ("n2", "", None, 0), ("n3", "other", None, 0), (None, "simple", None, 0), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    targets = spark.createDataFrame([("simple", 0.4, 20), ("intermediate", 0.5, 20), ("expert", 0.05, 10), ("Open-ended", 0.05, 5), (None, 1.0, 1), ("complex", None, None)], "difficulty string, target_share double, min_rows int")
    sample, report = category_sample(df, targets, size=200)
    got = {r["category"]: r for r in report.collect()}
    assert got["expert"]["drawn"] == 4 and not got["open_ended"]["met"] and got["open_ended"]["drawn"] == 0
    out = sample.collect()
    assert len(out) == len({r["id"] for r in out}) == sum(r["drawn"] for r in got.values()) == 200
    assert {c: sum(r["category"] == c for r in out) for c in got} == {c: r["drawn"] for c, r in got.items()}
    assert {c: sorted(r["rank"] for r in out if r["category"] == c) for c in got} == {c: list(range(1, r["drawn"] + 1)) for c, r in got.items()}
    assert abs(got["intermediate"]["drawn"] - 100) <= 12
    # The same rows whatever the partitioning.
    global drawn
    drawn = globals().get("drawn") or sorted(map(tuple, out))
    assert sorted(map(tuple, out)) == drawn
    assert category_sample(df.limit(0), targets)[0].count() == 0
    assert set(DIFFICULTY_TREE) >= {"simple", "expert"}

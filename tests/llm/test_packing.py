import random

import numpy as np
import pytest

from docloom.llm.packing import best_fit, containers, fill_report, improve, pack


@pytest.mark.parametrize("seed", range(5))
def test_every_item_once_and_no_container_over_capacity(seed):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 100, 500)
    at = pack(sizes, 100)
    assert np.bincount(at, sizes).max() <= 100
    # Two items above half a container never share one.
    assert at.max() + 1 <= max((sizes > 50).sum(), np.ceil(sizes.sum() / 100)) * 1.03 + 1


def test_local_search_empties_containers():
    sizes = np.array([51, 27, 26, 23, 23, 50, 26, 24])
    bins = [[0, 1], [2, 3, 4], [5], [6, 7]]
    before = len(bins)
    after = improve([list(b) for b in bins], sizes, 100)
    assert sorted(i for b in after for i in b) == list(range(8))
    assert len(after) < before and all(sizes[b].sum() <= 100 for b in after)


def test_best_fit_takes_the_tightest_container():
    assert best_fit(np.array([60, 50, 40]), 100) == [[0, 2], [1]]


def test_frame(spark):
    draw = random.Random(2)
    rows = [(i, draw.randint(1, 90)) for i in range(400)] + [(1000, 250), (1001, 200), (1002, 0), (1003, None), (None, 7), (5, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    out = containers(df, "doc_id", 100, shard=20).collect()
    per = {}
    for r in out:
        per[r["container"]] = per.get(r["container"], 0) + r["tokens"]
    assert max(per.values()) <= 100
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
    expected = {k: max(n for i, n in rows if i == k and n is not None) for k in {i for i, n in rows if n}}
    assert total == expected
    assert sorted((r["part"], r["begin"], r["tokens"]) for r in out if r["doc_id"] == 1000) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(r["part"] == 0 for r in out if r["doc_id"] not in (1000, 1001))
    report = fill_report(containers(df, "doc_id", 100, shard=20), 100).first()
    assert report["containers"] == len(per) and report["containers"] <= report["least_possible"] * 1.06 + 1
    assert containers(df.limit(0), "doc_id", 100).count() == 0
    with pytest.raises(ValueError):
        containers(df, "doc_id", 0)

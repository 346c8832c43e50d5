import itertools
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.grouping import components, file_key, grouped_split, linked_files

RECORD = "id string, prov struct<source:string,sources:array<string>>, root int"


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, small, seed):
    draw = random.Random(seed)
    edges = [(f"f{draw.randrange(120)}", f"f{draw.randrange(120)}") for _ in range(90)] + [(f"p{i}", f"p{i + 1}") for i in range(30)]
    rows = components(spark.createDataFrame(edges + [(None, "x")], "a string, b string"), small).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["v"])
    assert sorted(map(sorted, groups.values())) == union_find(edges)
    assert len(rows) == len({r["v"] for r in rows})


def test_spellings(spark):
    names = ["a-b.pdf", "/data/raw/A-B.PDF", "C:\\drop\\a-b.pdf", " a-b.pdf\t", "file:///srv/in/a-b.pdf", "INBOX/a-b.Pdf", "./a-b.pdf", "https://x.org/y/a-b.pdf?v=1#p2", "a%2Db.pdf"]
    df = spark.createDataFrame([(n,) for n in names + ["", "  ", None]], "n string").select(file_key(F.col("n")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["a-b.pdf"] * len(names) + [None] * 3


def test_linked_files(spark):
    rows = [("r1", ("A.pdf", ["b.pdf"]), 1), ("r2", ("in/B.PDF", ["c.pdf", None]), 1), ("r3", ("d.pdf", None), 1), ("r4", None, 1), ("r5", (None, ["unknown.pdf", "d.pdf"]), 1), ("r6", ("unknown.pdf", ["e.pdf"]), 1), (None, ("a.pdf", ["a.pdf"]), 1)]
    files = spark.createDataFrame([(f"{x}.pdf",) for x in "abcde"] + [(None,)], "source string")
    got = {tuple(r) for r in linked_files(spark.createDataFrame(rows, RECORD), files).collect()}
    assert got == {("a.pdf", "b.pdf"), ("a.pdf", "c.pdf"), ("b.pdf", "c.pdf"), ("d.pdf", "e.pdf")}
    star = {tuple(r) for r in linked_files(spark.createDataFrame(rows, RECORD), files, expand=2).collect()}
    assert star == {("a.pdf", "b.pdf"), ("a.pdf", "c.pdf"), ("d.pdf", "e.pdf")}


def test_pairs_of_a_large_component_are_all_there(spark):
    names = [f"f{i:04d}.pdf" for i in range(2100)]
    df, files = spark.createDataFrame([("r", ("f0000.pdf", names), 1)], RECORD), spark.createDataFrame([(n,) for n in names], "source string")
    out = linked_files(df, files).where("source_a < source_b")
    assert out.count() == out.distinct().count() == 2100 * 2099 // 2


def test_split_keeps_groups_together_and_meets_shares(spark):
    draw = random.Random(5)
    rows = [(f"r{i}", ("hot.pdf", []) if i % 3 == 0 else (f"f{draw.randrange(900)}.pdf", [f"f{draw.randrange(900)}.pdf"] if i % 29 == 0 else []), 0) for i in range(3000)]
    rows += [(f"n{i}", None, 0) for i in range(300)] + [rows[0], (None, None, 0)]
    df = spark.createDataFrame(rows, RECORD)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split_name string, target_share double")
    out = grouped_split(df, targets).collect()
    assert len(out) == 3300 == len({r["id"] for r in out})
    split = {r["id"]: r["split_name"] for r in out}
    edges, first = [], {}
    for i, prov, _ in rows[:3000]:
        for name in [prov[0], *prov[1]]:
            edges.append((i, name))
    for group in union_find(edges):
        assert len({split[x] for x in group if x in split}) == 1
    shares = {s: sum(v == s for v in split.values()) / 3300 for s in ("train", "validation", "test")}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    assert grouped_split(df.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        grouped_split(df, targets.where("split_name = 'none'"))

import itertools
import random

import numpy as np
import pytest

from docloom.llm.neardup import MOST_BITS, bit_map, class_rows, near_duplicates, pair_rows
from docloom.llm.repetition import words_of


def brute(rows, threshold):
    out = set()
    for (i, a), (j, b) in itertools.combinations([(i, set(words_of(t))) for i, t in rows if t and words_of(t)], 2):
        if i != j and len(a & b) >= threshold * len(a | b) - 1e-12:
            out.add((min(i, j), max(i, j)))
    return out


def texts(seed, n=220, vocabulary=400):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.6:
            words = draw.choice(rows)[1].split()
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(vocabulary)}"
            draw.shuffle(words)
        else:
            words = [f"w{int(draw.random() ** 3 * vocabulary)}" for _ in range(draw.randint(1, 25))]
        rows.append((f"id{i:04d}", " ".join(words)))
    return rows


@pytest.mark.parametrize("threshold,hot,listed,most_bits", [(0.75, 48, 1 << 20, MOST_BITS), (0.8, 2, 1 << 20, MOST_BITS), (0.75, 3, 40, MOST_BITS), (0.75, 8, 0, 1), (0.6, 2, 10, 1)])
def test_equals_brute_force_whatever_the_plan(spark, threshold, hot, listed, most_bits):
    rows = texts(7)
    df = spark.createDataFrame(rows, "id string, text string")
    members, links = near_duplicates(df, threshold=threshold, hot=hot, listed=listed, most_bits=most_bits)
    assert {tuple(r) for r in pair_rows(members, links).collect()} == brute(rows, threshold)


def test_one_group_of_copies_holds_a_third(spark):
    rows = texts(3, 60) + [(f"c{i:03d}", "the same words again and again in one group") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, text string")
    members, links = near_duplicates(df)
    own = {r["id"]: r for r in class_rows(members, links).collect()}
    assert own["c000"]["copies"] == 40 and len({own[f"c{i:03d}"]["cls"] for i in range(40)}) == 1
    assert {tuple(r) for r in pair_rows(members, links).collect()} == brute(rows, 0.75)
    star = {tuple(r) for r in pair_rows(members, links, expand=20).collect()}
    assert {p for p in star if "c000" in p} >= {("c000", f"c{i:03d}") for i in range(1, 40)}
    assert {p for p in star if not {x for x in p if x.startswith("c")}} == {p for p in brute(rows, 0.75) if not {x for x in p if x.startswith("c")}}
    assert not any(a.startswith("c") and b.startswith("c") and a != "c000" for a, b in star)


def test_different_texts_of_one_class_are_written_out_in_blocks(spark):
    words = "one two three four five six".split()
    rows = [(f"c{i:03d}", " ".join(words[i % 6 :] + words[: i % 6]) + "!" * (i // 6)) for i in range(60)] + [(f"d{i:03d}", "one two three four five six seven") for i in range(30)]
    members, links = near_duplicates(spark.createDataFrame(rows, "id string, text string"))
    assert {tuple(r) for r in pair_rows(members, links, block=7).collect()} == brute(rows, 0.75)
    got = {tuple(r) for r in pair_rows(members, links, expand=10, block=7).collect()}
    assert got == {p for p in brute(rows, 0.75) if not (p[1].startswith("d") and p[1] != "d000" and p[0] != "d000")}


def test_map_of_hashes(spark):
    draw = np.random.default_rng(1)
    held, other = draw.integers(-(1 << 63), 1 << 63, 3000), draw.integers(-(1 << 63), 1 << 63, 3000)
    made = bit_map(spark.createDataFrame([(int(x),) for x in held], "h bigint"), 3000)
    assert made.hit(held).all() and made.hit(other).mean() < 0.1
    assert bit_map(spark.range(5).withColumnRenamed("id", "h"), 5, 16) is None


def test_nulls_repeats_empty_and_clashing_names(spark):
    rows = [("a", "one two three four", 1), ("a", "one two three four", 2), ("b", "ONE two, three four!", 3), ("c", None, 4), (None, "one two three four", 5), ("d", " ", 6), ("e", "w " * 50_000, 7), ("f", "only this row comes twice", 8), ("f", "only this row comes twice", 9), ("g", "this row only comes twice here", 9)]
    df = spark.createDataFrame(rows, "id string, text string, cls int")
    members, links = near_duplicates(df)
    assert sorted(tuple(r) for r in pair_rows(members, links).collect()) == [("a", "b"), ("f", "g")]
    assert class_rows(members, links).count() == 5 and links.count() == 1
    members, links = near_duplicates(df.limit(0))
    assert pair_rows(members, links).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, threshold=0.5)

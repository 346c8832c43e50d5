import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, column, *values, names="a b c".split()):
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<double>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.mark.parametrize("text,expected", [(None, []), ("", []), ("The Cat's 3.5% of a run-up", ["cat", "3.5%", "run-up"]), ("Ärger übt x", ["rger", "bt"])])
def test_terms(spark, text, expected):
    assert one(spark, T.terms(F.col("a")), text) == expected


@pytest.mark.parametrize("text,expected", [("1,000 and -2.5, 3-5 or 1,23", [1000.0, -2.5, 3.0, -5.0, 1.0, 23.0]), (None, []), ("3e-4", [3.0, -4.0])])
def test_numbers(spark, text, expected):
    assert one(spark, T.numbers(F.col("a")), text) == expected


def test_shingles(spark):
    assert one(spark, T.shingles(F.col("a")), "A b c d e f f") == ["a b c d e", "b c d e f", "c d e f f"]
    assert one(spark, T.shingles(F.col("a")), "a b") == ["a b"] and one(spark, T.shingles(F.col("a")), " ") == [] and one(spark, T.shingles(F.col("a")), None) == []


def test_entropy_and_f1_equal_counters(spark):
    draw = random.Random(1)
    rows = [([draw.choice("abcde") for _ in range(draw.randint(0, 12))], [draw.choice("abcde") for _ in range(draw.randint(0, 12))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", T.entropy(F.col("a")).alias("e"), T.term_f1(F.col("a"), F.col("b")).alias("f"), T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    for r in got:
        n, c, d = len(r["a"]), Counter(r["a"]), Counter(r["b"])
        assert math.isclose(r["e"], -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0, abs_tol=1e-9)
        common = sum((c & d).values())
        assert math.isclose(r["f"], 1.0 if not n + len(r["b"]) else 2 * common / (n + len(r["b"])), abs_tol=1e-9)
        assert math.isclose(r["j"], len(set(c) & set(d)) / len(set(c) | set(d)) if c and d else 0.0)


def test_names(spark):
    assert one(spark, T.normalized_name(F.col("a")), "  (Sparse  Routing) Network. ") == "sparse routing) network"
    for raw, expected in {"data-sets": "dataset", "class": "class", "runs": "runs", "glass": "glass"}.items():
        assert one(spark, T.collapsed_name(F.col("a")), raw) == expected


def test_agreement(spark):
    for a, b, expected in [("about 10.05", "10.0", True), ("12", "10", False), ("", "x", True), ("Yes", "yes it is", True), ("no", "other", False)]:
        assert one(spark, T.observations_agree(F.col("a"), F.col("b")), a, b) is expected
    assert one(spark, T.numeric_match(F.col("a"), F.col("b")), [10.0], [10.04, 20.0]) == 0.5


def test_refusal_marker_and_json(spark):
    assert one(spark, T.is_refusal(F.col("a")), " 'UNANSWERABLE.' ") and not one(spark, T.is_refusal(F.col("a")), "It says UNANSWERABLE")
    for text, expected in [('text ```json\n{"k": 1}\n``` more', "1"), ('so: {"k": 1} end', "1"), ('{"k": 1}', "1"), ("no json", None), (None, None)]:
        assert one(spark, F.try_variant_get(T.recovered_json(F.col("a")), "$.k", "string"), text) == expected


def test_let_computes_once_and_gives_the_same(spark):
    assert one(spark, T.let(F.split("a", ","), lambda x: F.transform(x, lambda y: F.concat(y, F.size(x).cast("string")))), "a,b") == ["a2", "b2"]


def test_ids_are_of_content(spark):
    import hashlib

    assert one(spark, T.chunk_id(F.col("a"), F.col("b")), "s", "t" * 600) == hashlib.sha1(("s\x1f" + "t" * 512).encode()).hexdigest()[:16]
    assert one(spark, T.citation(F.col("a"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>"), F.col("b")), "s.pdf", "X > Y") == "s.pdf Y"

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.repetition import batch_repetition, repetition, words_of


def brute(text, run):
    ws = words_of(text)
    n, seen, covered, longest = len(ws), set(), [0] * len(ws), 0
    for k in range(n - run + 1):
        gram = tuple(ws[k : k + run])
        if gram in seen:
            covered[k : k + run] = [1] * run
        seen.add(gram)
    for i in range(n):
        for j in range(i + 1, n):
            size = 0
            while j + size < n and ws[i + size] == ws[j + size]:
                size += 1
            longest = max(longest, size)
    return n, sum(covered), longest if longest >= run else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab c", max_size=80)), max_size=12), st.sampled_from([1, 2, 3, 8]))
def test_equals_brute_force(texts, run):
    got = batch_repetition(texts, run)
    for text, *mine in zip(texts, *got):
        assert tuple(mine) == brute(text, run)


def test_documents_do_not_repeat_each_other():
    text = "one two three four five six seven eight nine"
    assert batch_repetition([text, text], 8)[1].tolist() == [0, 0]


def test_long_text_and_words_of_other_scripts():
    text = "Привет мир это текст о том как дела İstanbul " * 20_000
    n, repeated, longest = (x[0] for x in batch_repetition([text], 8))
    assert n == 180_000 and repeated == n - 9 and longest == n - 9


def test_frame_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b " * 20, "y"), (3, "  ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    out = {(r["doc_id"], r["n_words"]): r for r in repetition(df).collect()}
    assert repetition(df).count() == 4
    assert out[1, 0]["repeated_share"] == 0.0 and out[None, 40]["repeated_share"] == 0.95
    assert repetition(df.limit(0)).count() == 0


def test_batches_are_cut_by_size(spark):
    random.seed(1)
    df = spark.createDataFrame([(i, " ".join(random.choice("abcdefgh") for _ in range(50))) for i in range(40)], "doc_id int, text string")
    one = sorted(map(tuple, repetition(df, run=3).collect()))
    assert one == sorted(map(tuple, repetition(df, run=3, batch_chars=120).collect()))

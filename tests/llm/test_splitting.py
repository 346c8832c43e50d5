import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting
from docloom.llm.splitting import cut_positions, pieces_of, split_oversized


def rebuilt(text, spans):
    out = text[spans[0][0] : spans[0][1]]
    for (_, end), (_, stop) in zip(spans, spans[1:]):
        out += text[end:stop]
    return out


@settings(max_examples=80, deadline=None)
@given(st.text("ab. \n,|", min_size=0, max_size=900), st.sampled_from([(90, 0), (90, 6), (200, 12)]))
def test_round_trip_limits_and_overlap(text, size):
    most, overlap = size
    spans = pieces_of(text, most, overlap)
    assert rebuilt(text, spans) == text
    assert all(b - a <= most for a, b in spans)
    for (_, end), (begin, _) in zip(spans, spans[1:]):
        assert (end - begin) // 4 == overlap


def test_doubling_gives_the_cuts_of_a_walk():
    text = " ".join(f"word{i}." if i % 7 == 0 else f"w{i}" for i in range(3000))
    most, overlap = 400, 43
    ends = cut_positions(text, most, overlap)
    # A walk that asks for one cut at a time.
    at, walked = 0, []
    while at < len(text):
        rest = text[at - overlap if walked else 0 :]
        step = cut_positions(rest, most, overlap)[0]
        at = (at - overlap if walked else 0) + step
        walked.append(at)
    assert ends[-1] == walked[-1] == len(text)
    assert len(ends) == len(walked)


def test_prefers_paragraphs_then_sentences():
    text = ("a" * 30 + ". ") * 3 + "\n\n" + "b" * 80
    assert text[: pieces_of(text, 120, 0)[0][1]].endswith("\n\n")


def test_text_without_any_pause():
    spans = pieces_of("x" * 10_000, 400, 10)
    assert rebuilt("x" * 10_000, spans) == "x" * 10_000 and max(b - a for a, b in spans) <= 400


def test_frame(spark):
    big = "Some words here. " * 40
    rows = [("a", big, 1), ("a", big, 2), ("b", None, 3), ("c", "short", 4), (None, big, 5)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    out = split_oversized(df, max_tokens=60, overlap_tokens=5).collect()
    assert {r["id"] for r in out} == {"a", None}
    own = sorted((r["piece"], r["text"]) for r in out if r["id"] == "a")
    assert len(own) == len({p for p, _ in own}) == out[0]["n_pieces"]
    assert all(r["tokens"] <= 60 for r in out)
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, max_tokens=10, overlap_tokens=5)


def test_limit_is_what_the_estimate_says(spark):
    df = spark.createDataFrame([("x", "a" * 3603), ("y", "a" * 3604)], "id string, text string")
    assert [r["id"] for r in splitting.oversized(df, "text", 900).collect()] == ["y"]

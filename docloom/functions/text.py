"""Scalar functions as Column expressions; none of them needs Python workers.

Null text counts as empty text in all of them unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: What counts as a term for grounding and retrieval, and as a number.
TERM = r"[A-Za-z0-9_.%-]+"
NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"
# Words that are no terms.
STOP = (
    "the a an of and or to in is are was were for on by with as that this it at from be has have had which not we our its their "
    "what how why when where does do did can could would should than then"
).split()


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that is used inside a lambda is otherwise evaluated for every
    element of the array the lambda runs over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_list(text: Column) -> Column:
    """Lower-cased words of a text in order; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text_of(text), "İ", "i")), F.lit(WORD), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text_of(text)) / 4).cast("int"))


def terms(text: Column) -> Column:
    """Lower-cased terms in order, without stop words and single characters."""
    raw = F.transform(F.regexp_extract_all(text_of(text), F.lit(TERM), F.lit(0)), F.lower)
    return F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(STOP))


def shingles(text: Column, k: int = 5, ascii: bool = False) -> Column:
    """Distinct runs of k words; a shorter text is one run, an empty one none. With `ascii` only [a-z0-9]+ are words, as in
    the reference."""

    def runs(words: Column) -> Column:
        last = F.greatest(F.size(words) - (k - 1), F.lit(1))
        made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(made))

    return let(F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z0-9]+"), F.lit(0)) if ascii else word_list(text), runs)


def numbers(text: Column) -> Column:
    """Every number as a double; thousands separators are read over. A hyphen before a digit is a sign."""
    return F.transform(F.regexp_extract_all(text_of(text), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(items: Column) -> Column:
    """Shannon entropy of an array in bits; 0 for an empty one. Runs of the sorted array are counted, so time grows with its length."""

    def bits(xs: Column) -> Column:
        weight = lambda run: F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
        same = lambda s, x: s["last"].eqNullSafe(x)
        step = lambda s, x: F.struct(x.alias("last"), F.when(same(s, x), s["run"] + 1).otherwise(1).alias("run"), F.when(same(s, x), s["sum"]).otherwise(s["sum"] + weight(s["run"])).alias("sum"))
        n = F.size(xs)
        total = F.aggregate(F.array_sort(xs), start, step, lambda s: s["sum"] + weight(s["run"]))
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.log2(n.cast("double")) - total / n, F.lit(0.0)))

    return let(items, bits)


def normalized_name(name: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one blank, without .,:;()[] at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text_of(name), r"^\s+|\s+$", "")), r"\s+", " "), r"^[ .,:;()\[\]]+|[ .,:;()\[\]]+$", "")


def collapsed_name(key: Column) -> Column:
    """Only [a-z0-9], a plural s of five or more characters cut off."""
    base = F.regexp_replace(key, "[^a-z0-9]", "")
    plural = (F.length(base) > 4) & F.endswith(base, F.lit("s")) & ~F.endswith(base, F.lit("ss"))
    return F.when(plural, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def near(a: Column, b: Column, share: float = 0.005, least: float = 0.01) -> Column:
    """Whether a is within max(least, share of b) of b."""
    return F.abs(a - b) <= F.greatest(F.lit(least), F.abs(b) * share)


def term_f1(answer: Column, reference: Column) -> Column:
    """F1 of two arrays of terms as multisets; 1 if both are empty, 0 if one is."""

    def count(a: Column, r: Column) -> Column:
        both = F.array_sort(F.array_intersect(a, r))
        each = F.transform(both, lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(r, lambda y: y == x))))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x)

    common = let(answer, lambda a: let(reference, lambda r: count(a, r)))
    n = F.size(answer) + F.size(reference)
    return F.when(n == 0, 1.0).when(common == 0, 0.0).otherwise(2.0 * common / n)


def numeric_match(answer: Column, reference: Column) -> Column:
    """Share of the reference's numbers that the answer has, within half a per cent; 1 if there are none."""
    hit = let(answer, lambda known: F.size(F.filter(reference, lambda r: F.exists(known, lambda a: near(a, r)))))
    return F.when(F.size(reference) == 0, 1.0).otherwise(hit / F.size(reference))


def observations_agree(claimed: Column, actual: Column) -> Column:
    """All claimed numbers occur in the actual output within one per cent; without numbers one text contains the other."""
    said, real = numbers(claimed), numbers(actual)
    a, b = F.lower(F.trim(text_of(claimed))), F.lower(F.trim(text_of(actual)))
    by_number = let(real, lambda known: F.forall(said, lambda s: F.exists(known, lambda r: near(s, r, 0.01))))
    return F.when((F.size(said) > 0) & (F.size(real) > 0), by_number).otherwise(F.contains(b, a) | F.contains(a, b))


def generated_text(turns: Column, answer: Column) -> Column:
    """All assistant turns of a dialogue, else the answer."""
    said = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: text_of(t["content"])), "\n")
    return F.when((F.size(F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>"))) > 0) & (said != ""), said).otherwise(text_of(answer))


def is_refusal(text: Column) -> Column:
    """Whether the marker UNANSWERABLE is the whole answer or its first word."""
    bare = F.upper(F.regexp_replace(text_of(text), r"^[\s\"'`*.]+|[\s\"'`*.]+$", ""))
    return (bare == "UNANSWERABLE") | F.startswith(bare, F.lit("UNANSWERABLE ")) | F.startswith(bare, F.lit("UNANSWERABLE."))


def citation(source: Column, pages: Column, anchors: Column, breadcrumb: Column) -> Column:
    """Source with the first page, else the first anchor, else the last part of the breadcrumb."""
    where = F.when(F.size(F.coalesce(pages, F.array().cast("array<int>"))) > 0, F.concat(F.lit("p"), pages[0].cast("string")))
    where = where.when(F.size(F.coalesce(anchors, F.array().cast("array<string>"))) > 0, anchors[0])
    where = where.otherwise(F.element_at(F.split(text_of(breadcrumb), " > "), -1))
    return F.when(text_of(where) == "", text_of(source)).otherwise(F.concat(text_of(source), F.lit(" "), where))


def content_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts, joined by the unit separator."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[text_of(p) for p in parts])), 1, 16)


def record_id(source: Column, question: Column, answer: Column, longest: int | None = 256) -> Column:
    """Over the first `longest` characters of the answer, or the whole answer with None, as the pipeline has it."""
    return content_id(source, question, F.substring(text_of(answer), 1, longest) if longest else answer)


def chunk_id(source: Column, text: Column, longest: int | None = 512) -> Column:
    """Over the first `longest` characters of the text, so that different texts with an equal beginning have one id, or the whole
    text with None, as the pipeline has it."""
    return content_id(source, F.substring(text_of(text), 1, longest) if longest else text)


def hash60(text: Column) -> Column:
    """The first 15 hex digits of the MD5 as a number; other engines can make the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def recovered_json(text: Column) -> Column:
    """A VARIANT from text that holds JSON: a fenced block, the whole text, the outermost [..] or the outermost {..}."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    options = [F.when(fenced != "", fenced), text, F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.try_parse_json(F.when(F.trim(x) != "", x)) for x in options])

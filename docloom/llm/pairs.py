"""Defective question-answer pairs: empty, refusal, copied, language, truncated.

Distinct responses are sorted by text over the whole collection, and each is compared with both of its neighbours. A common
prefix tells two things about a response with an open end: it is a shortened version of the neighbour (the prefix is all of it),
or it is a finished neighbour with a continuation that stops (the prefix is most of the neighbour). A histogram of the lengths
of responses with an open end shows length limits as spikes. What a response itself shows (open brackets, fences, tables,
lists, a last sentence that stops) settles the ones that have neither. Then come the rules for placeholders, refusals, copies
and languages; a pair gets the first defect that applies, and truncated pairs come with their evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

WORDS = re.compile(r"[^\W_]+")
#: A length is a limit if responses with an open end have it at least SPIKE times as often as the lengths up to SPIKE_AROUND
#: away do on average, and if chance gives that with a probability below exp(-SPIKE_NATS), at any size of the collection.
SPIKE, SPIKE_AROUND, SPIKE_NATS = 8.0, 10, 20.0
#: Share of a finished neighbour that a response must have in common to be compared with it; evidences from the strongest on.
ALIKE = 0.5
EVIDENCE = ("inside", "grown", "beginning", "alike")

# What stands in for an answer that isn't there.
PLACEHOLDER = re.compile(
    r"(?:n\s*/?\s*a|nan|none|null|nil|undefined|tbd|tba|todo|fixme|empty|blank|placeholder|pending|answer|a|response|antwort|réponse|respuesta|ответ|"
    r"no (?:answer|response|output|text)(?: (?:generated|given|provided|available|yet))?|(?:your|insert|the) (?:answer|text)(?: here)?|answer (?:here|goes here|pending)|"
    r"keine (?:antwort|angabe)|k a|sans réponse|sin respuesta|нет ответа|пусто|x+|lorem ipsum(?: dolor sit amet)?)?"
)
MARKUP = re.compile(r"</?\w+\s*/?>|[\W_]+")

# Who is silent or unable, by language.
SOURCE = r"(?:passage|text|context|document|source|excerpt|section|material|fragment|article|page|snippet|paragraph)"
REFUSAL = re.compile(
    r"\bi (?:can ?not|can't|could not|couldn't|am (?:not able|unable)|do not know|don't know|have no (?:way|information|idea|knowledge)|must (?:decline|refuse)|won't|will not|would rather not|decline|refuse)\b"
    r"|\b(?:falls?|is|lies) outside (?:of )?what i\b|\bnot something i (?:can|may|will)\b"
    r"|\bi'(?:m (?:not able|unable|afraid i)|d rather not|d prefer not|ve no )|\bunable to (?:answer|help|say|determine)"
    rf"|\b{SOURCE}\b(?: \w+){{0,3}} (?:does not|doesn't|do not|don't|is silent|makes no|gives no|has no|contains no|offers no|provides no|says nothing)\b|\bnothing in (?:the|this) {SOURCE}"
    rf"|\b(?:not|never|nowhere)(?: \w+)? (?:stated|mentioned|given|specified|covered|provided|found|answered|said|disclosed|contained)(?: anywhere)? (?:in|by|from) (?:the|this) (?:\w+ )?{SOURCE}"
    r"|\b(?:cannot|can't|can not|could not) be (?:determined|answered|said|derived|known|inferred|told)\b|^\W*(?:i )?(?:cannot|can't|can not) (?:answer|say|tell|help)"
    rf"|\b(?:not enough|insufficient|no) information\b|\bno answer can be\b|\bimpossible to (?:say|tell|know|answer|determine)\b|\b(?:unanswerable|not answerable)\b"
    r"|\bkann ich\b[^.]*\b(?:nicht|keine?n?)\b|\bich (?:kann|weiß|möchte|darf)\b[^.]*\b(?:nicht|keine?n?)\b|\blässt sich\b[^.]*\bnicht\b|\b(?:text|abschnitt|auszug|dokument|quelle|kontext|textstelle|ausschnitt)\b(?: \w+){0,2} (?:enthält|nennt|gibt|sagt|erwähnt|schweigt)\b[^.]*|\b(?:nicht|nichts) (?:im|in dem|aus dem) (?:text|abschnitt|auszug|dokument)|\bnicht (?:beantworten|beantwortbar)\b"
    r"|\bje (?:ne|n')\b[^.]*\b(?:pas|rien)\b|\bimpossible de (?:le )?(?:savoir|répondre|dire|déterminer)|\b(?:passage|texte|extrait|document|source|contexte)\b(?: \w+){0,2} (?:ne|n')[^.]*\b(?:pas|rien|aucune?)\b|\bne figure (?:pas|nulle part)|\bpas (?:dans|indiqué|précisé|mentionné)[^.]*\b(?:extrait|texte|passage|document)"
    r"|\bno puedo (?:responder|ayudar|contestar|decir)|\bno (?:es posible|se puede) (?:saber|responder|contestar|determinar|decir)|\b(?:fragmento|texto|pasaje|documento|extracto|contexto|fuente)\b(?: \w+){0,2} no (?:menciona|ofrece|dice|indica|contiene|da|aclara|incluye|lo|habla)|\bno (?:lo sé|sabría)\b|\bno (?:figura|aparece|consta|se menciona|se indica) (?:en|eso en)"
    r"|\b(?:не могу|нельзя|невозможно)\b[^.]*\b(?:ответить|помочь|сказать|узнать|определить)|\b(?:ответить|сказать|узнать|определить)\b[^.]*\b(?:нельзя|невозможно|не могу)|\b(?:отрывк|текст|документ|источник|контекст|фрагмент)\w*\b[^.]*\b(?:не|ничего|нет|молчит)\b|\bя не знаю\b|\bне знаю\b"
)
#: End of a sentence, for telling which sentences of a response decline.
STOP = re.compile(r"(?<=[.!?…。！？])[\"'”»)]*\s+|\n+")

# Words that a finished sentence does not end with.
OPEN_WORDS = set(
    "the a an of and or to in on at by for with from that which because since while if when as is are was were be has have its their this than into between over under so but not may can must will "
    "der die das ein eine einen und oder zu mit von bei auf in im am für weil wenn dass ist sind wird nicht "
    "le la les un une des et ou de du à au aux dans sur pour par que qui est sont avec "
    "el los las uno una y o del en con por para que se su es son "
    "и или в на с по из к для что как при от у не".split()
)
CLOSED = ".!?…。！？"
QUOTES = "\"'”’»“)]}*_`"
SENTENCE = re.compile(r"[.!?…][\"”»)]*\s+[^\W\d_a-zà-ÿа-яё]")
PAIRED = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}
ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+")
QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"")


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    return bool(PLACEHOLDER.fullmatch(MARKUP.sub(" ", re.sub(r"[​-‏⁠﻿]", "", text)).strip().lower()))


def is_refusal(text: str) -> bool:
    """Whether the first or the last sentence declines, or half of the text does, and the other sentences give no value; of
    a response of one or two sentences one that declines is enough. The length of the response plays no part."""
    plain = text.replace("’", "'").lower()
    if not REFUSAL.search(plain):
        return False
    sentences = [x for x in STOP.split(plain) if x.strip()]
    no = [bool(REFUSAL.search(x)) for x in sentences]
    if len(sentences) <= 2 or not any(no):
        return True
    declined = sum(len(x) for x, n in zip(sentences, no) if n)
    values = sum(any(c.isdigit() for c in x) for x, n in zip(sentences, no) if not n)
    return (no[0] or no[-1] or 2 * declined >= len(plain)) and 2 * values <= len(sentences) - sum(no)


def close_words(a: str, b: str) -> bool:
    """Whether two words differ by one or two edits (swapped, missing or changed characters)."""
    if abs(len(a) - len(b)) > 1 or len(a) < 3:
        return False
    if len(a) == len(b) and (sum(x != y for x, y in zip(a, b)) <= 1 or sorted(a) == sorted(b)):
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 2


def is_copy(question: str, text: str) -> bool:
    """The response holds most of the question and nothing else but a few words of introduction."""
    asked, said = WORDS.findall(question.lower()), WORDS.findall(text.lower())
    if len(asked) < 3 or not said:
        return False
    known, told = set(asked), set(said)
    extra = [w for w in told if w not in known]
    if len(extra) > 4 + 0.25 * len(told) or len(told & known) < 0.5 * len(known):
        return False
    missing = [w for w in known if w not in told]
    extra = [w for w in extra if not any(close_words(w, m) for m in missing)]
    matched = len(told) - len(extra)
    if matched < 0.7 * len(known) or any(c.isdigit() for w in extra for c in w):
        return False
    # New words may introduce the copy; inside and after it hardly any may stand.
    new, begin = set(extra), 0
    while begin < len(said) and said[begin] in new:
        begin += 1
    return begin <= 5 and sum(w in new for w in said[begin:]) <= max(1, 0.1 * (len(said) - begin))


def unfinished(text: str) -> str:
    """'yes' if the response shows itself that it stops early, 'no' if it is finished, 'open' if it may be a fragment."""
    t = text.strip()
    if not t:
        return "no"
    if "```" in t:
        return "yes" if t.count("```") % 2 else "no"
    if t[0] in "{[" and re.match(r"[{\[]\s*[\"{\[\d\]}]", t):
        bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", t)
        return "no" if '"' not in bare and bare.count("{") == bare.count("}") and bare.count("[") == bare.count("]") else "yes"
    lines = [x for x in t.split("\n") if x.strip()]
    if lines[0].lstrip().startswith("|") or (len(lines) > 1 and lines[-1].lstrip().startswith("|")):
        rows = [x.strip() for x in lines if x.lstrip().startswith("|")]
        last = lines[-1].strip()
        if not last.startswith("|"):
            return "yes" if unfinished(last) == "yes" else "no"
        return "no" if last.endswith("|") and last.count("|") >= rows[0].count("|") and len(rows) != 2 else "yes"
    if len(lines) > 1 and ITEM.match(lines[-1] + " ") and ITEM.match(lines[-2] + " "):
        body = [ITEM.sub("", x + " ", count=1).strip() for x in lines if ITEM.match(x + " ")]
        last, others = body[-1], body[:-1]
        if not last or last[-1] in ",;:(":
            return "yes"
        if all(":" in x for x in others) and ":" not in last:
            return "yes"
        return "yes" if all(x[-1:] in CLOSED for x in others if x) and last[-1] not in CLOSED else "no"
    for a, b in PAIRED.items():
        if t.count(a) > t.count(b) and not re.search(r"(?:^|\s)[:;]-?\(", t):
            return "yes"
    end = t.rstrip(QUOTES) if t[-1] in QUOTES else t
    if not end or end[-1] in CLOSED:
        return "no"
    if t[-1] in ",;:-–—(/&" and len(t) > 1:
        return "yes"
    if re.search(r"(?:^|\s)(?:\d{1,2}[.)]|[a-z]\))$", t) and len(t.split()) > 3:
        return "yes"
    if t[-1] in "»”\")]}" and SENTENCE.search(t) is None:
        return "open"
    words = WORDS.findall(t.lower())
    if words and words[-1] in OPEN_WORDS and len(words) > 2:
        return "yes"
    return "yes" if SENTENCE.search(t) else "open"


NO_LANGUAGE = {"", "und", "mul", "zxx", "unknown", "none", "null"}


class Languages:
    """A naive Bayes model over words, made from the word counts of each label."""

    def __init__(self, totals: dict[str, int], words: Iterable[tuple[str, dict[str, int]]]) -> None:
        # A label with hardly any words is noise in the labels, not a language.
        most = max(totals.values(), default=0)
        totals = {k: n for k, n in totals.items() if n >= 0.01 * most}
        self.names = sorted(totals)
        self.logs = {w: np.array([math.log((counts.get(k, 0) + 0.3) / (totals[k] + 1000)) for k in self.names]) for w, counts in words}

    def scores(self, text: str) -> np.ndarray:
        return self.scores_of(WORDS.findall(text.lower()))

    def scores_of(self, words: list[str]) -> np.ndarray:
        got = [self.logs[w] for w in words if w in self.logs]
        return np.sum(got, axis=0) if got else np.zeros(len(self.names))

    def differs(self, question: str, text: str, margin: float = 4.0) -> bool:
        """Whether the response is clearly in another language than the question."""
        asked, said = self.scores(question), self.scores(QUOTED.sub(" ", text))
        if len(self.names) < 2 or not asked.any() or not said.any():
            return False
        mine = int(asked.argmax())
        # Words cannot come more than a few nats closer to one language each; short texts need fewer of them.
        return said.max() - said[mine] > margin and np.sort(asked)[-1] - np.sort(asked)[-2] > 1.0


def counted(rows: DataFrame, least: int) -> Languages:
    """The model of (label, words) rows. What comes to the driver are counts of the words that occur at least `least` times."""
    # Labels of one sample are few, but nothing says so: those with hardly any words are left out before anything is collected.
    sizes = rows.groupBy("label").agg(F.sum(F.size("words")).alias("n"))
    top = sizes.agg(F.max("n")).first()[0] or 0
    totals = {r["label"]: r["n"] for r in sizes.where(F.col("n") >= 0.01 * top).collect()}
    per = rows.where(F.col("label").isin(list(totals))).select("label", F.explode("words").alias("w")).groupBy("w", "label").agg(F.count("*").alias("n"))
    words = per.groupBy("w").agg(F.sum("n").alias("all"), F.collect_list(F.struct("label", "n")).alias("by")).where(F.col("all") >= least)
    return Languages(totals, ((r["w"], {x["label"]: x["n"] for x in r["by"]}) for r in words.collect()))


def language_model(labelled: DataFrame, sample: int, least: int = 3) -> Languages:
    """Fitted on the `sample` distinct texts of the smallest hash. Words are taken and counted on the executors. Labels are
    compared by their primary subtag: EN and en-GB are en; 'und' and the like name no language. Some labels are wrong; the
    fitted model corrects them, and the second fit is the one that counts."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": [re.split(r"[-_]", x.strip().lower())[0] for x in frame["label"]], "words": [[w for w in WORDS.findall(QUOTED.sub(" ", t).lower()) if not w.isdigit()] for t in frame["text"]]})

    rows = cut(labelled_sample(labelled, sample).mapInPandas(words, "label string, words array<string>"))
    first = counted(rows.where(~F.col("label").isin(*NO_LANGUAGE)), least)
    if len(first.names) < 2:
        return first
    known = labelled.sparkSession.sparkContext.broadcast(first)

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = known.value
        for frame in frames:
            scores = [model.scores_of(list(w)) for w in frame["words"]]
            keep = [i for i, s in enumerate(scores) if s.any()]
            yield pd.DataFrame({"label": [model.names[int(scores[i].argmax())] for i in keep], "words": [frame["words"].iloc[i] for i in keep]})

    return counted(cut(rows.mapInPandas(again, "label string, words array<string>")), least)


def pair_table(records: DataFrame) -> DataFrame:
    """(id, slot, question, text), once each: the answers, and the rejected answers where a rejection mode is set."""
    slots = F.array(F.struct(F.lit("answer").alias("slot"), F.col("answer").alias("text")), F.when(F.col("rejection_mode").isNotNull(), F.struct(F.lit("rejected").alias("slot"), F.col("rejected").alias("text"))))
    rows = records.select("id", "question", F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("s"))
    return rows.select("id", "question", "s.slot", "s.text")


def common_prefix(a: str, b: str) -> int:
    """Number of leading characters that two texts share, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a.startswith(b[low:middle], low):
            low = middle
        else:
            high = middle - 1
    return low


def neighbour_evidence(text: str, near: str) -> str | None:
    """What a neighbour in the order of all responses says about one whose end is open: `inside` if it is the neighbour's
    beginning and stops inside a word, `beginning` if it stops elsewhere, `grown` if it goes on where a finished neighbour of
    five words or more ends, `alike` if it shares most of a finished neighbour."""
    whole, other = text.rstrip(), near.rstrip()
    shared = common_prefix(whole, other)
    if shared == len(whole) < len(other):
        return "inside" if whole[-1].isalpha() and other[shared].isalpha() and " " in whole else "beginning"
    if shared >= ALIKE * len(other) and unfinished(near) == "no":
        ends = shared >= len(other.rstrip(CLOSED + QUOTES)) and len(WORDS.findall(other)) >= 5
        return "grown" if ends else "alike"
    return None


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text, so that joins need not carry it."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def neighbours(pairs: DataFrame, partitions: int) -> DataFrame:
    """(k1, k2, evidence): what the neighbours of the distinct responses say, for those whose end is open and that have any.

    Distinct texts are range-partitioned, so copies of one text can't make a hot range. Over the border of two ranges the last
    text of the one meets the first text of the other; these, two a range, are all that reaches the driver.
    """
    texts = pairs.where(F.rlike("text", F.lit(r"\S"))).select("text").distinct()
    ranges = cut(texts.repartitionByRange(partitions, "text").sortWithinPartitions("text").withColumn("range", F.spark_partition_id()).select("text", "range", *text_key(F.col("text"))))
    ends = ranges.groupBy("range").agg(F.min("text").alias("head"), F.max("text").alias("tail")).orderBy("range").collect()
    after = {a["range"]: b["head"] for a, b in zip(ends, ends[1:])}
    before = {b["range"]: a["tail"] for a, b in zip(ends, ends[1:])}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(last, row, following):
            text, _, k1, k2 = row
            if text.rstrip()[-1:] in CLOSED or text.isspace():
                return
            said = [e for near in (following, last) if near is not None and (e := neighbour_evidence(text, near))]
            if said:
                found.append((k1, k2, min(said, key=EVIDENCE.index)))

        last, row, found = None, None, []
        for batch in batches:
            for following in zip(*(c.to_pylist() for c in batch.columns)):
                if row is None:
                    last = before.get(following[1])
                else:
                    judged(last, row, following[0])
                    last = row[0]
                row = following
            yield evidence_batch(found)
            found = []
        if row is not None:
            judged(last, row, after.get(row[1]))
            yield evidence_batch(found)

    return ranges.mapInArrow(work, "k1 bigint, k2 bigint, evidence string")


def evidence_batch(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kinds[i]) for i in range(3)], ["k1", "k2", "evidence"])


def length_limits(open_ends: DataFrame) -> DataFrame:
    """(n): lengths at which distinct responses with an open end pile up; open_ends: (k1, k2, n)."""
    counts = open_ends.distinct().groupBy("n").agg(F.count("*").alias("c"))
    near = counts.select("n", "c", F.explode(F.sequence(F.col("n") - SPIKE_AROUND, F.col("n") + SPIKE_AROUND)).alias("at"))
    around = near.groupBy("at").agg(F.sum(F.when(F.col("at") == F.col("n"), F.col("c"))).alias("c"), F.sum(F.when(F.col("at") != F.col("n"), F.col("c"))).alias("others"))
    mean = F.greatest(F.coalesce("others", F.lit(0)) / (2 * SPIKE_AROUND), F.lit(0.05))
    # Chernoff's bound of a Poisson number of that mean.
    nats = F.col("c") * F.log(F.col("c") / mean) - F.col("c") + mean
    return around.where(F.col("c").isNotNull() & (F.col("c") >= SPIKE * mean) & (nats >= SPIKE_NATS)).select(F.col("at").alias("n"))


def labelled_sample(rows: DataFrame, sample: int) -> DataFrame:
    """The `sample` distinct texts of the smallest hash with one label each. Rows of larger hashes are filtered out first, so
    every task hands on a few rows, however large the table is."""
    share = min(1.0, 4 * sample / max(1, rows.count()))
    low = rows.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    return low.groupBy("text").agg(F.min("label").alias("label")).orderBy(F.xxhash64("text")).limit(sample)


def judged_pairs(records: DataFrame, labelled: DataFrame | None = None, sample: int = 3000) -> DataFrame:
    """(id, slot, defect, evidence) of the pairs that have a defect; one row a pair.

    records: id, question, answer, rejected, rejection_mode; other columns are ignored, repeated rows count once, a null id
    stays null. labelled: (text, label) rows of which the `sample` texts of the smallest hash fit the language model; without
    it the language rule is off. A null, blank or wordless response is `empty` whatever the question; with a null or blank
    question the copy and language rules do not apply. Texts are read whole, of any length. evidence is `neighbour`, `length`
    or `form` for truncated pairs and `rule` for all others.
    """
    spark = records.sparkSession
    pairs = pair_table(records)
    languages = language_model(labelled.where("text is not null and label is not null"), sample) if labelled is not None else None
    model = spark.sparkContext.broadcast(languages)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    beside = neighbours(pairs, partitions)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = model.value
        for frame in frames:
            out = []
            for i, slot, question, text, k1, k2 in zip(*(frame[c] for c in ("id", "slot", "question", "text", "k1", "k2"))):
                if is_empty(text):
                    out.append((i, slot, "empty", None, k1, k2, 0))
                    continue
                state = unfinished(text)
                if is_refusal(text):
                    defect = "refusal"
                elif question and question.strip() and is_copy(question, text):
                    defect = "copied"
                elif not (state == "yes" and text.lstrip()[:1] in "|{[`") and words is not None and question and words.differs(question, text):
                    defect = "language"
                elif state == "no":
                    continue
                else:
                    defect = None
                out.append((i, slot, defect, state, k1, k2, len(text)))
            yield pd.DataFrame(out, columns=["id", "slot", "defect", "state", "k1", "k2", "n"])

    kind = pairs.schema["id"].dataType.simpleString()
    judged = cut(pairs.select("id", "slot", "question", "text", *text_key(F.col("text"))).mapInPandas(work, f"id {kind}, slot string, defect string, state string, k1 bigint, k2 bigint, n int"))
    clear = judged.where("defect is not null").select("id", "slot", "defect", F.lit("rule").alias("evidence"))
    # Neighbours first, then lengths; the form of the response settles what has neither.
    open_ends = judged.where("defect is null")
    limits = length_limits(open_ends.select("k1", "k2", "n")).withColumn("limit", F.lit(True))
    seen = open_ends.join(beside, ["k1", "k2"], "left").join(limits, "n", "left")
    stops = F.col("state") == "yes"
    evidence = F.when((stops & F.col("evidence").isNotNull()) | F.col("evidence").isin("inside", "grown"), "neighbour").when(F.col("limit"), "length").when(stops, "form")
    cut_short = seen.select("id", "slot", F.lit("truncated").alias("defect"), evidence.alias("evidence")).where("evidence is not null")
    return clear.unionByName(cut_short).distinct()


def defective_pairs(records: DataFrame, labelled: DataFrame | None = None, sample: int = 3000) -> DataFrame:
    """(id, slot, defect) of the pairs that have a defect; see judged_pairs."""
    return judged_pairs(records, labelled, sample).select("id", "slot", "defect").distinct()

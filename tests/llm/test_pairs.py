import pytest

from docloom.llm.pairs import common_prefix, defective_pairs, is_copy, is_empty, is_refusal, judged_pairs, language_model, length_limits, neighbour_evidence, unfinished

SCHEMA = "id string, question string, answer string, rejected string, rejection_mode string, slot int, text string"


@pytest.mark.parametrize("text", [None, "", " \n\t", "​", "N/A", "null", "...", "{}", "[]", "```\n```", "<answer></answer>", "**Answer:**", "[answer]", "(no answer generated)", "TBD", "—", "NaN", '""', "Réponse :"])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["5", "No", "Yes.", "23.0 litres", "Nature", "None of the units failed."])
def test_short_answers_are_answers(text):
    assert not is_empty(text)


@pytest.mark.parametrize("text", [
    "I don't know.", "I'm sorry, but I can’t help with that request.", "UNANSWERABLE", "The passage doesn't say.", "Not stated in the document. Please share more of the document.",
    "To be honest, nothing in the excerpt covers Pruka.", "Cannot answer.", "That falls outside what I may discuss.", "No answer can be given from this context.", "Tut mir leid, dabei kann ich nicht helfen.",
    "Der Abschnitt enthält keine Angaben zu Zuka.", "Impossible de le savoir avec ce texte.", "Le passage ne dit rien sur Zuka.", "No puedo responder a eso.", "El fragmento no menciona Zuka.", "По этому тексту ответить нельзя.", "В отрывке ничего не сказано о Zuka.",
])
def test_refusals(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", [
    "The operators could not reproduce it at first, and nobody can answer for the rotor shaft yet. Still, Zuka reached 5.97 grams.",
    "It does not accept mixed readings over 3.9 rpm.", "Zuka cannot handle damp readings above 4 mm.", "Между 24 и 32 pages для «датчик» ничего не меняется.", "Der Kühlkreis lässt keine Werte über 5 mm zu.",
])
def test_negations_are_no_refusals(text):
    assert not is_refusal(text)


@pytest.mark.parametrize("text,state", [
    ("It is done. The value was rea", "yes"), ("The cause is that the", "yes"), ("See (the table", "yes"), ('{"a": "b', "yes"), ('{"a": "b"}', "no"), ("```python\nx = 1\n", "yes"), ("```\nx\n```", "no"),
    ("| a | b |\n| --- | --- |\n| 1 |", "yes"), ("| a | b |\n| --- | --- |\n| 1 | 2 |", "no"), ("1. One.\n2. Two.\n3. Thr", "yes"), ("- a: 1\n- b: 2 oily", "no"), ("The clamp bolt", "open"), ("All is well.", "no"),
    ("He said “yes.”", "no"), ("There are two: 1) one, 2)", "yes"),
])
def test_unfinished(text, state):
    assert unfinished(text) == state


def test_copies():
    q = "How high is the recall of Zuka over Rima in run Aba/1234567/x9?"
    for a in (q, f"You want to know: {q.lower()}", f"{q} {q}", q.upper(), q.replace("1234567", "1234657"), q.replace("?", ".")):
        assert is_copy(q, a)
    assert not is_copy(q, "Zuka reaches 52 mm of recall over Rima in run Aba/1234567/x9.")
    assert not is_copy(q, "Rima") and not is_copy("", "a b c")


TALK = {
    "en": "The value of the pump was read in the morning and it is the best of the year. ", "de": "Der Wert der Pumpe wurde am Morgen gelesen und ist der beste des Jahres. ",
    "fr": "La valeur de la pompe est lue le matin et elle est la meilleure de l'année. ",
}


def test_language_labels_in_many_spellings(spark):
    rows = [(f"{t} {k} {i}", k) for k, t in TALK.items() for i in range(20)] + [(f"{TALK['en']} {i} {k}", k) for i in range(10) for k in ("EN", "en-GB")] + [(TALK["de"], "en"), (TALK["en"], "und")]
    model = language_model(spark.createDataFrame(rows, "text string, label string"), 3000)
    assert model.names == ["de", "en", "fr"]
    assert model.differs(TALK["en"], TALK["de"]) and not model.differs(TALK["en"], TALK["en"])
    assert not model.differs(TALK["en"], "The pump reads “Der Wert der Pumpe wurde am Morgen gelesen” in the morning.")


def test_frame(spark):
    full = "The loss of the pump is large and it grows with every single day of use."
    rows = [
        ("a", "What is the loss of the pump?", None, None, None), ("b", "What is the loss of the pump?", full, "I don't know.", "conflation"), ("c", "What is the loss of the pump?", full[:40], None, None),
        ("d", "Who?", full, "ignored", None), ("e", None, "N/A", "", "x"), (None, "What is the loss of the pump today?", "What is the loss of the pump today?", None, None), ("f", "q", "long " * 60_000 + "end.", None, None),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows + rows[:2]], SCHEMA)
    labelled = spark.createDataFrame([(t, k, 0) for k, t in TALK.items()] + [(None, "en", 0)], "text string, label string, id int")
    got = sorted(((r["id"], r["slot"], r["defect"]) for r in defective_pairs(df, labelled).collect()), key=str)
    assert got == sorted([("a", "answer", "empty"), ("b", "rejected", "refusal"), ("c", "answer", "truncated"), ("e", "answer", "empty"), ("e", "rejected", "empty"), (None, "answer", "copied")], key=str)
    assert defective_pairs(df.limit(0), labelled.limit(0)).count() == 0


def test_neighbours_over_range_borders(spark):
    base = [f"The pump number {i} was read twice." for i in range(200)]
    cuts = [b[:-5] for b in base[::10]] + [b[:-1] + ", although it was only" for b in base[5::10]]
    rows = [(f"{i}", "What was read?", t, None, None) for i, t in enumerate(base + cuts)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, rejected string, rejection_mode string")
    got = judged_pairs(df).collect()
    assert {r["id"] for r in got} == {str(i) for i in range(200, 240)} and {r["defect"] for r in got} == {"truncated"}
    assert sum(r["evidence"] == "neighbour" for r in got) == 40


def test_evidence_of_neighbours():
    assert common_prefix("abcd", "abxd") == 2 and common_prefix("", "a") == 0 and common_prefix("ab", "abc") == 2 and common_prefix("abc", "abc") == 3
    assert neighbour_evidence("The pump was re", "The pump was read twice.") == "inside"
    assert neighbour_evidence("702 %", "702 % of recall") == "beginning"
    assert neighbour_evidence("The pump was read twice, since the", "The pump was read twice.") == "grown"
    assert neighbour_evidence("The pump was read again, since the", "The pump was read twice.") == "alike"
    assert neighbour_evidence("Yes 5", "Yes.") == "alike"
    assert neighbour_evidence("Zuka", "The pump.") is None and neighbour_evidence("The pump", "The pump") is None


def test_length_limits(spark):
    rows = [(i, 0, 20 + i % 60) for i in range(600)] + [(1000 + i, 0, 48) for i in range(110)] + [(5000 + i, 0, 70) for i in range(4)] * 50
    assert [r["n"] for r in length_limits(spark.createDataFrame(rows, "k1 bigint, k2 bigint, n int")).collect()] == [48]


def test_long_refusals():
    assert is_refusal("I can't answer this from the document. " + "Please send the part that covers the unit and its settings. " * 8)
    assert not is_refusal("The recall is 52 mm. The operators could not be reached, and the passage does not say why. " + "The drift was 4 mm and the loss 7 dB. " * 8)

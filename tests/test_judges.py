import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.model import judges, synth
from docloom.model.client import Backend, ModelError, Offline, completed
from docloom.model.runtime import BudgetExceeded, Runtime, readable
from docloom.operators import gates
from docloom.pipeline import whole_record
from docloom.tools import replay, sqltool

TRACE = "array<struct<thought:string,action:string,action_input:string,observation:string,executed_observation:string,executed_ok:boolean>>"
RECORD = f"id string, question string, answer string, context string, task string, images array<string>, tool_trace {TRACE}, tool_env struct<grids:array<array<array<string>>>,captions:array<string>>, turns array<struct<role:string,content:string>>"
GRID = [["Unit", "Value"], ["Zuka", "12"], ["Rima", "7"]]


@dataclass
class Scripted(Backend):
    """Replies by the TASK line of a prompt."""

    replies: dict = None

    def complete(self, prompt, temperature=0.0, most=1000, images=()):
        reply = self.replies[prompt.split("\n")[0].removeprefix("TASK: ")]
        if reply is None:
            raise ModelError("down")
        return reply if isinstance(reply, str) else json.dumps(reply)


def record(i, answer="Zuka reached 12 litres in the morning run.", task="qa", trace=None, images=None, context="In the morning run Zuka reached 12 litres. Rima stayed at 7 litres."):
    steps = [(None, *s, None, None) for s in trace] if trace else None
    return (i, f"How many litres did unit {i} reach in the run?", answer, context, task, images, steps, ([GRID], ["Table 1"]) if trace else None, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def stages(df):
    return {r["id"]: {g["stage"]: g for g in r["gates"]} for r in df.collect()}


FINE = {"judge": {"label": "entailment", "confidence": 0.9}, "reverse": {"answerable_without_source": False}, "clarity": {"standalone": 1, "specific": 1, "natural": 1, "answer_complete": 1}, "symbolic": {"applicable": True, "code": "print('PASS')"}, "solver": {"applicable": False}, "answer": "Zuka reached 12 litres in the morning run."}


def test_waves_of_gates(spark, tmp_path):
    picture = tmp_path / "p.png"
    picture.write_bytes(b"x")
    rows = gates.cheap_gates(frame(spark, record("a"), record("b", answer="It was 99 litres, they say, in the run of Zuka."), record("f", task="figure_qa", images=[str(picture)]), record("g", task="figure_qa", images=["/nowhere/x.png"])))
    out = stages(judges.verified(rows, Scripted(FINE), samples=2, allow_python=True))
    assert set(out["a"]) >= {"nli_forward", "nli_reverse", "clarity", "self_consistency", "symbolic", "z3"} and all(g["passed"] for g in out["a"].values())
    assert not out["b"]["numeric_grounding"]["passed"] and "nli_forward" not in out["b"]
    assert out["f"]["visual_grounding"]["score"] == 0.9 and "nli_forward" not in out["f"] and "symbolic" not in out["f"]
    assert out["g"]["visual_grounding"]["detail"] == "no image"


def test_rejections_stop_the_next_wave(spark):
    rows = gates.cheap_gates(frame(spark, record("a")))
    out = stages(judges.verified(rows, Scripted(FINE | {"reverse": {"answerable_without_source": True, "matches_source_answer": True, "confidence": 0.8}})))["a"]
    assert not out["nli_reverse"]["passed"] and abs(out["nli_reverse"]["score"] - 0.2) < 1e-9 and "symbolic" not in out
    out = stages(judges.verified(rows, Scripted(FINE | {"clarity": "I like it.", "judge": "Yes!", "symbolic": None})))["a"]
    assert out["clarity"]["inconclusive"] and out["nli_forward"]["inconclusive"] and out["symbolic"]["passed"]
    out = stages(judges.verified(rows, Scripted(FINE)))["a"]
    assert out["symbolic"]["inconclusive"] and out["symbolic"]["passed"]


def test_code_and_solver():
    assert judges.code_verdict(True, "print('PASS' if 2 + 2 == 4 else 'FAIL')", True)[0] and not judges.code_verdict(True, "print('FAIL')", True)[0]
    assert not judges.code_verdict(True, "1 / 0", True)[0] and judges.code_verdict(False, "x", True)[:2] == (True, 1.0)
    said = {"c": "sat", "n": "unsat", "bad": "error"}
    solve = said.get
    assert judges.solver_verdict(True, "c", "n", solve)[:2] == (True, 1.0) and judges.solver_verdict(True, "c", "c", solve)[:2] == (False, 0.0)
    assert judges.solver_verdict(True, "n", None, solve)[0] is False and judges.solver_verdict(True, "bad", "n", solve)[1] == 0.5
    assert judges.solver_verdict(True, "c", None, solve)[1] == 0.7 and judges.solver_verdict(True, "c", "bad", solve)[1] == 0.6 and judges.solver_verdict(None, "c", "n", solve)[1] == 1.0


def test_long_contexts_are_judged_window_by_window(spark):
    @dataclass
    class Finder(Backend):
        def complete(self, prompt, temperature=0.0, most=1000, images=()):
            return json.dumps({"label": "entailment" if "needle" in prompt.split("<<<")[1] else "neutral", "confidence": 0.9})

    rows = frame(spark, record("a", context="x " * 20_000 + "needle"), record("b", context="x " * 20_000), record("c", context=None))
    out = {r["id"]: r["gate"] for r in judges.entailment_gates(rows, Finder()).collect()}
    assert out["a"]["passed"] and not out["b"]["passed"] and not out["c"]["passed"]
    windows = synth.windowed(rows.select("id", "context"), 1000)
    assert windows.where("id = 'a'").count() == 45 and windows.where("id = 'c'").count() == 1
    assert windows.agg(F.max(F.length("window"))).first()[0] == 1000


def test_traces_as_a_gate(spark):
    good, wrong, off = ("sql", "SELECT sum(value) FROM t", "19"), ("sql", "SELECT max(value) FROM t", "40"), ("python", "print(1)", "1")
    rows = frame(spark, record("good", trace=[good]), record("wrong", trace=[good, wrong]), record("off", trace=[good, off]), record("only", trace=[off]), record("odd", trace=[("fly", "x", "y")]), record("none"))
    out = {r["id"]: r for r in replay.trace_gates(rows).collect()}
    assert out["good"]["trace_gate"]["passed"] and not out["wrong"]["trace_gate"]["passed"] and out["wrong"]["trace_gate"]["score"] == 0.5
    assert out["off"]["trace_gate"]["inconclusive"] and out["only"]["trace_gate"]["inconclusive"] and not out["odd"]["trace_gate"]["passed"]
    assert out["none"]["trace_gate"] is None and out["good"]["tool_trace"][0]["executed_ok"]
    checked = stages(gates.cheap_gates(replay.trace_gates(rows)))
    assert "trace_execution" in checked["good"] and "trace_execution" not in checked["none"]


def test_repair_leaves_disabled_tools_alone(spark):
    before = [(None, "python", "print(5)", "5", "5", True), (None, "sql", "SELECT max(value) FROM t", "40", None, None), (None, "sql", "SELECT nothing", "3", None, None)]
    row = record("a")
    df = spark.createDataFrame([(*row[:6], before, ([GRID], ["Table 1"]), None)], RECORD)
    got = replay.repair_traces(df).first()
    assert got["repaired"] == 1 and got["tool_trace"][0]["executed_observation"] == "5" and got["tool_trace"][0]["executed_ok"]
    assert got["tool_trace"][1]["observation"] == "12" and got["tool_trace"][2]["observation"] == "3" and not got["tool_trace"][2]["executed_ok"]


@pytest.mark.parametrize("sql", ["WITH t AS (SELECT 1 a) INSERT INTO x SELECT * FROM t", "WITH t AS (SELECT 1 a) FROM t INSERT INTO x SELECT * INSERT INTO y SELECT *", "DROP TABLE t", "SELECT java_method('java.lang.System', 'exit', 1)", "select reflect('a', 'b')"])
def test_writes_are_refused_at_any_depth(spark, sql):
    with pytest.raises(Exception) as error:
        sqltool.query(spark, sql)
    assert isinstance(error.value, sqltool.ReadOnlyError) or "PARSE" in str(error.value)
    assert not sqltool.run_query(spark, sql)[0]


def test_interactive_queries_have_a_limit_and_a_deadline(spark):
    ok, text = sqltool.run_query(spark, "WITH t AS (SELECT id FROM range(1000)) SELECT * FROM t WHERE id IN (SELECT id FROM t) ORDER BY id")
    assert ok and len(text.split("\n")) == 50
    assert not sqltool.run_query(spark, "SELECT sum(a.id * b.id % 7) FROM range(3000000) a CROSS JOIN range(3000000) b", deadline=2)[0]
    assert sqltool.describe_schema([GRID, [["x"]]], ["Table 1"]) == "t(unit, value) -- Table 1"


CHUNK = "id string, doc_id string, source string, text string, breadcrumb string, node_ids array<string>, tables array<string>, grids array<array<array<string>>>, resolved_refs string"


def test_tool_records_see_the_tables_of_their_document(spark):
    other = [["City", "Size"], ["A", "1"]]
    chunks = spark.createDataFrame([("c1", "d", "d.md", "Zuka reached 12 litres in the run.", "Results", ["n1"], None, [GRID], None), ("c2", "d", "d.md", "Cities of size 1 are small.", "Cities", ["n2"], None, [other, GRID], None), ("c3", "e", "e.md", "Nothing of note here at all.", None, None, None, None, None)], CHUNK)
    own = {r["id"]: r for r in synth.table_registry(chunks).collect()}
    assert own["c1"]["grids"] == [GRID, other] and own["c2"]["grids"] == [other, GRID] and own["c3"]["grids"] == [] and own["c1"]["captions"] == ["Results", "Cities"]
    made = {r["source"]: r for r in synth.generate_react(chunks, Offline()).select("*", "prov.source").collect()}
    assert made["d.md"]["task"] == "react" and made["d.md"]["tool_trace"][0]["action"] == "lookup" and made["e.md"]["tool_env"]["grids"] == []
    assert whole_record(synth.generate_react(chunks, Offline())).count() == 3
    assert synth.generate_react(chunks, Scripted({"react": {"question": "q", "trace": []}})).count() == 0
    assert synth.generate_react(chunks, Scripted({"react": "no object"})).count() == 0


def test_figures_and_harder_questions(spark):
    chunks = spark.createDataFrame([("c1", "d", "d.md", "Zuka reached 12 litres in the run of the day.", "Results", ["n1"], None, None, None)], CHUNK)
    figures = spark.createDataFrame([("c1", "fig-1", "a.png", "Figure 1: litres", [0.0, 0.0, 5.0, 5.0]), ("c1", "fig-2", None, "x", None), ("gone", "fig-3", "b.png", None, None)], "chunk_id string, node_id string, image_path string, caption string, bbox array<double>")
    seen = Scripted({"figure_qa": [{"question": "What is shown?", "answer": "Litres by unit."}, {"question": "", "answer": "x"}]})
    got = whole_record(synth.generate_figure_qa(chunks, figures, seen)).collect()
    assert len(got) == 1 and got[0]["images"] == ["a.png"] and got[0]["context"].startswith("Figure 1") and "fig-1" in got[0]["prov"]["node_ids"] and got[0]["prov"]["bboxes"] == [[0.0, 0.0, 5.0, 5.0]]
    base = whole_record(synth.generate_qa(chunks, Offline()))
    more = synth.evolved(base, Offline(), share=1.0).collect()
    assert len(more) == base.count() and all(r["difficulty"] == "complex" and r["prov"]["generator"].startswith("evolve:") for r in more)
    assert synth.evolved(base, Scripted({"evolve": {"applied": False, "question": "q", "answer": "a"}}), share=1.0).count() == 0


def test_ids_tell_long_texts_apart(spark):
    df = spark.createDataFrame([("x" * 600 + "a",), ("x" * 600 + "b",)], "t string")
    assert df.select(T.chunk_id(F.lit("s"), F.col("t"), None)).distinct().count() == 2 == df.select(T.record_id(F.lit("s"), F.lit("q"), F.col("t"), None)).distinct().count()
    assert df.select(T.chunk_id(F.lit("s"), F.col("t"))).distinct().count() == 1


def test_runtime_counts_and_refuses(spark):
    prompts = spark.createDataFrame([("TASK: judge\n<<<\nabc\n>>>",)] * 6, "prompt string")
    runtime = Runtime.on(spark, {"generate": Scripted({"judge": "no json"}), "verify": Scripted({"judge": FINE["judge"]}), "vision": Scripted({"judge": None})}, budget=10_000)
    assert completed(prompts, runtime, role="verify", json_reply=True).where("ok").count() == 6
    completed(prompts, runtime, json_reply=True, retries=0).select("reply").collect()
    health = {h["role"]: h for h in runtime.health()}
    assert health["verify"]["calls"] == 6 and health["verify"]["unparsed"] == 0 and health["generate"]["unparsed"] == 6 and health["generate"]["tokens_in"] > 0
    assert completed(prompts, runtime, role="vision", retries=0).where("ok").count() == 0
    with pytest.raises(ModelError):
        completed(prompts, runtime, role="vision")
    runtime.budget = 5
    with pytest.raises(BudgetExceeded):
        completed(prompts, runtime)
    with pytest.raises(ValueError):
        Runtime.on(spark, {"verify": Offline()})
    assert readable('Sure: {"a": 1}') and not readable("none") and not readable(None)

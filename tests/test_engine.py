import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import cli, config, registry
from docloom.cache import Cache, content_fingerprint, fingerprint, row_fingerprint
from docloom.model.client import Backend, Caller, Offline, completed
from docloom.operators import audit, choose, evaluate, gates, geometry, graph, retrieve
from docloom.pipeline import Pipeline
from docloom.plans.catalogue import QUERIES, SQL
from docloom.sources import files, formats
from docloom.streaming import incremental
from docloom.tools import replay, sqltool

DATA = "/root/testdata/sf0.001"
GRID = [["Method", "Score (%)", "Score (%)"], ["a", "1,000", "5%"], ["b", "2", ""]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
def test_every_query_says_what_its_sql_says(spark):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")

    def plain(v):
        if isinstance(v, float) or (isinstance(v, int) and not isinstance(v, bool)) or type(v).__name__ == "Decimal":
            return round(float(v), 6) + 0.0
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v

    wrong = []
    for name, sql in SQL.items():
        got = QUERIES[name](spark, DATA)
        theirs = connection.execute(sql)
        order = [c[0] for c in theirs.description]
        mine = sorted((tuple(map(plain, r)) for r in got.select(*[F.col(f"`{c}`") for c in order]).collect()), key=repr)
        if mine != sorted((tuple(map(plain, r)) for r in theirs.fetchall()), key=repr):
            wrong.append(name)
    assert not wrong and len(SQL) > 50


def test_sql_tool(spark):
    assert sqltool.column_names(["A b", "", "A b", "2x"]) == ["a_b", "col_1", "a_b_2", "c_2x"]
    assert sqltool.table_names(["x", "Table 4: y", None], 3) == ["t", "table_4", "t3"]
    assert sqltool.run_sqlite("SELECT sum(score) FROM t", [GRID]) == (True, "1002") and sqltool.run_sqlite("SELECT 1 WHERE 0", [GRID])[1] == "(no rows)"
    assert not sqltool.run_sqlite("DELETE FROM t", [GRID])[0] and not sqltool.run_sqlite("WITH x AS (SELECT 1) DELETE FROM t", [GRID])[0]
    assert not sqltool.run_sqlite("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n) SELECT count(*) FROM n", [GRID], deadline=0.5)[0]
    sqltool.register_grids(spark, [GRID])
    assert sqltool.query(spark, "SELECT sum(score) AS s FROM t").first()["s"] == 1002
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "SET x=1"):
        with pytest.raises(sqltool.ReadOnlyError):
            sqltool.query(spark, bad)


def test_replay(spark):
    step = lambda a, i, o: {"thought": "", "action": a, "action_input": i, "observation": o, "executed_observation": None, "executed_ok": None}
    rows = [("a", "the bolt is 5 mm wide", [step("sql", "a", "1000"), step("lookup", "bolt", "5")], {"grids": [GRID], "captions": []}), ("b", "", [step("sql", "SELECT score FROM t WHERE method = 'b'", "7")], {"grids": [GRID], "captions": []}), ("c", "", [step("python", "print(1)", "1")], None), ("d", "", [], None)]
    df = spark.createDataFrame(rows, "id string, context string, tool_trace array<struct<thought:string,action:string,action_input:string,observation:string,executed_observation:string,executed_ok:boolean>>, tool_env struct<grids:array<array<array<string>>>,captions:array<string>>")
    out = {r["id"]: r for r in replay.replay_traces(df).collect()}
    assert out["a"]["passed"] and not out["b"]["passed"] and out["c"]["inconclusive"] and "d" not in out
    assert {r["id"]: r["repaired"] for r in replay.repair_traces(df).collect()}["b"] == 1
    assert replay.run_python("print(2 + 3)") == (True, "5") and not replay.run_python("import os")[0] and not replay.run_python("open('/etc/passwd')")[0]


def test_gates_and_score(spark):
    rows = [("good", "What does the pump of Zuka reach in total?", "The pump reaches 5.5 mm in winter.", "In winter the pump reaches 5.5 mm.", "qa"), ("number", "What does the pump of Zuka reach in total?", "The pump reaches 7 mm in winter.", "In winter the pump reaches 5.5 mm.", "qa"), ("null", None, None, None, None)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "id string, question string, answer string, context string, task string, turns array<struct<role:string,content:string>>, tool_trace array<struct<executed_ok:boolean,executed_observation:string>>, images array<string>")
    out = {r["id"]: r for r in gates.cheap_gates(df).select("id", gates.quality_score(F.col("gates")).alias("q"), gates.verdict_flags(F.col("gates")).alias("f")).collect()}
    assert out["good"]["f"] == [] and out["good"]["q"] > 0.8 and out["number"]["f"] == ["reject:numeric_grounding"] and "reject:structural" in out["null"]["f"]


def test_percentiles_balance_and_splits(spark):
    draw = random.Random(1)
    values = [draw.random() for _ in range(501)]
    got = {r["share"]: r["value"] for r in audit.element_percentiles(spark.createDataFrame([(v,) for v in values + [None]], "q double"), "q").collect()}
    assert got == {s: sorted(values)[min(500, int(s * 501))] for s in (0.1, 0.5, 0.9)}
    assert audit.element_percentiles(spark.createDataFrame([], "q double"), "q").count() == 0
    rows = [(f"r{i:03d}", draw.choice(["simple", "complex"]), draw.choice([0.2, 0.7, None])) for i in range(300)]
    out = choose.balance(spark.createDataFrame(rows, "id string, bucket string, quality double"), total=100).collect()
    ranked = lambda rs: sorted(rs, key=lambda r: (1 - (r[2] or 0.0), r[0]))
    first = [r for b, n in (("simple", 25), ("complex", 30)) for r in ranked([x for x in rows if x[1] == b])[:n]]
    rest = ranked([r for r in rows if r not in first])[: 100 - len(first)]
    assert {r["id"] for r in out} == {r[0] for r in first + rest}
    sources = spark.createDataFrame([(i, f"s{i % 40}" if i % 7 else None) for i in range(2000)], "id int, source string")
    split = choose.split_by_source(sources, "id", "source").collect()
    where = {}
    for r in split:
        where.setdefault(f"s{r['id'] % 40}" if r["id"] % 7 else None, set()).add(r["split"])
    assert len(split) == 2000 and all(len(v) == 1 for v in where.values())
    assert len({r["split"] for r in choose.split_by_source(sources.where("source = 's1'"), "id", "source").collect()}) == 3


def test_graph(spark):
    chunks = spark.createDataFrame([("c1", "a.md", ["Doc"], "The Sparse Routing Network uses Adam"), ("c2", "b.md", ["Doc"], "Here SRN beats Rival Method"), ("c3", "c.md", ["Other"], "Rival Method and Third Thing at 5 ms"), ("c4", "c.md", [], None)], "id string, source string, section_path array<string>, text string")
    found, known, edges = graph.build(chunks)
    keys = {r["key"] for r in known.collect()}
    assert "srn" not in keys and "rival method" in keys
    seeds = spark.createDataFrame([("adam",)], "key string")
    hops = {r["key"]: r["hops"] for r in graph.within_hops(edges, seeds).collect()}
    assert hops["adam"] == 0 and hops["rival method"] == 2 and hops["third thing"] == 3
    pairs = {(r["a"], r["b"]) for r in graph.bridging_pairs(found, known, edges).collect()}
    assert ("adam", "rival method") in pairs
    assert {r["a"] for r in graph.cross_document(found, known, edges).collect()} >= {"rival method"}
    assert graph.bridging_pairs(*graph.build(chunks.limit(0))).count() == 0


def test_bridging_equals_the_whole_search(spark):
    draw = random.Random(3)
    rows = [(f"c{i:02d}", f"s{i % 5}.md", [], " x ".join(f"Name{draw.randrange(40):02d}" for _ in range(3))) for i in range(40)]
    built = graph.build(spark.createDataFrame(rows, "id string, source string, section_path array<string>, text string"))
    few = [tuple(r) for r in graph.bridging_pairs(*built, limit=10, first=2).collect()]
    assert few == [tuple(r) for r in graph.bridging_pairs(*built, limit=10, first=1000).collect()]


def test_bm25_by_hand(spark):
    passages = spark.createDataFrame([("a", "pump valve pump"), ("b", "valve seal"), ("c", None)], "id string, text string")
    queries = spark.createDataFrame([(1, "the pump"), (2, "nothing here"), (3, None)], "q int, t string")
    out = retrieve.bm25_topk(passages, queries, "id", "text", "q", "t").collect()
    norm = 2 + 1.5 * (0.25 + 0.75 * 3 / 2)
    assert [(r["query"], r["id"]) for r in out] == [(1, "a")] and abs(out[0]["score"] - np.log(1 + 2.5 / 1.5) * 2 * 2.5 / norm) < 1e-6


def test_geometry(spark):
    boxes = np.array([[0, 0, 10, 10], [12, 0, 20, 10], [100, 100, 140, 140]], float)
    assert len(geometry.merge_boxes(boxes, 4.0)) == 2
    fragments = spark.createDataFrame([("d", 0, float(x), float(x + 20), float(y), float(y + 8), 8.0, "t") for y in (0, 20, 40) for x in (0, 50, 100)] + [("d", 0, 0.0, 300.0, 60.0, 68.0, 12.0, "prose")], "doc_id string, page int, x0 double, x1 double, y0 double, y1 double, height double, text string")
    rows = geometry.fragment_rows(fragments)
    assert rows.select("row").distinct().count() == 4
    table = geometry.aligned_tables(rows).collect()
    assert [(r["first_row"], r["last_row"], r["n_cols"]) for r in table] == [(0, 2, 3)]
    assert geometry.body_size(fragments).first()["size"] == 8.0
    figures = spark.createDataFrame([("d", 0, [0.0, 0.0, 50.0, 50.0]), ("d", 1, [0.0, 0.0, 50.0, 50.0])], "doc_id string, page int, bbox array<double>")
    assert geometry.without_tables(figures, figures.where("page = 0")).collect()[0]["page"] == 1
    labels = spark.createDataFrame([("d", 0, [52.0, 20.0, 60.0, 28.0], "label"), ("d", 0, [52.0, 30.0, 400.0, 38.0], "far")], "doc_id string, page int, bbox array<double>, text string")
    grown = {r["page"]: r["bbox"] for r in geometry.absorb_labels(figures, labels).collect()}
    assert grown[0] == [0.0, 0.0, 60.0, 50.0] and grown[1] == [0.0, 0.0, 50.0, 50.0]


class Flaky(Backend):
    def __init__(self, fails):
        self.fails, self.calls = fails, 0

    def complete(self, prompt, temperature=0.0, most=1000, images=()):
        self.calls += 1
        if self.calls <= self.fails:
            raise OSError("down")
        return "fine"


def test_model_calls(spark):
    call = Caller(Flaky(1), retries=2, pause=0)
    assert call("x", 0, 1)[0] == "fine"
    dead = Caller(Flaky(10**9), retries=0, pause=0, dead=3)
    assert [dead("x", 0, 1)[0] for _ in range(5)] == [None] * 5 and dead.backend.calls == 3
    out = completed(spark.createDataFrame([(1, "TASK: answer\n<<<\nThe pump is five metres wide.\n>>>"), (2, None)], "id int, prompt string"), Offline()).collect()
    assert out[0]["reply"].startswith("The pump") and all(r["ok"] for r in out)


def test_questions_in_any_shape(spark):
    lines = [json.dumps(x) for x in ({"question": "q1"}, {"prompt": "q2"}, {"instruction": "q3", "input": ""}, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q4"}]}, {"conversations": [{"from": "human", "value": "q5"}]}, {"messages": [{"role": "user", "content": [{"type": "image", "image": "a"}, {"type": "text", "text": "q6"}]}]}, {"other": 1}, [1], "x")] + ["{broken", ""]
    got = [r["question"] for r in files.questions_of(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == ["q1", "q2", "q3", "q4", "q5", "q6"]


def test_formats(spark):
    rows = [("a", "q?", "yes", "ctx", "qa", None, None, None, ["x.png"], "no"), ("b", "q2", "no", None, "multiturn", [("user", "u"), ("assistant", "v")], None, None, None, None)]
    df = spark.createDataFrame([(*r[:5], "neutral", "simple", 1, *r[5:8], r[8], {"quality": 0.5}, [], ("s.pdf", [], [], "b"), r[9], "m" if r[9] else None) for r in rows], "id string, question string, answer string, context string, task string, persona string, difficulty string, hops int, turns array<struct<role:string,content:string>>, tool_trace array<struct<thought:string,action:string,action_input:string,observation:string,executed_observation:string,executed_ok:boolean>>, tool_env struct<grids:array<array<array<string>>>,captions:array<string>>, images array<string>, scores map<string,double>, flags array<string>, prov struct<source:string,pages:array<int>,node_ids:array<string>,breadcrumb:string>, rejected string, rejection_mode string")
    df = df.withColumn("prov", F.col("prov").withField("anchors", F.array().cast("array<string>")))
    read = lambda name: [json.loads(r["value"]) for r in formats.formatted(df, name).collect()]
    assert [len(r["messages"]) for r in read("chatml")] == [3, 3] and read("chatml")[0]["meta"]["quality"] == 0.5
    assert read("sharegpt")[1]["conversations"] == [{"from": "human", "value": "u"}, {"from": "gpt", "value": "v"}]
    assert len(read("dpo")) == 1 and read("dpo")[0]["rejected"] == "no" and read("react") == []
    shown = read("multimodal")[0]["messages"]
    assert shown[0]["content"] == [{"type": "image", "image": "x.png"}, {"type": "text", "text": "q?"}] and shown[1]["content"] == "yes"
    assert set(read("raw")[0]) == set(df.columns) and set(read("alpaca")[0]) == {"instruction", "input", "output", "meta"}
    with pytest.raises(ValueError):
        formats.formatted(df, "nope")


def test_cache_and_config(spark, tmp_path):
    store, made = Cache(spark, str(tmp_path / "cache")), []
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    make = lambda: made.append(1) or row_fingerprint(df)
    assert store.memoize("s", "k", make).count() == store.memoize("s", "k", make).count() == 2 and len(made) == 1
    assert store.missing(row_fingerprint(df.union(spark.createDataFrame([(3, "c")], df.schema))), "s", "k").count() == 1
    assert content_fingerprint(df) == content_fingerprint(df.orderBy(F.desc("id"))) != content_fingerprint(df.limit(1))
    store.invalidate()
    assert not store.has("s", "k") and fingerprint(1, "a") == fingerprint(1, "a") != fingerprint("1", "a")
    with pytest.raises(ValueError, match="max_tokens"):
        config.build(config.Config, {"chunking": {"max_token": 5}})
    with pytest.raises(ValueError):
        config.build(config.Config, {"chunking": {"max_tokens": 5}}).validate()


def test_plugins(spark, tmp_path):
    (tmp_path / "own.py").write_text("from docloom import registry\n@registry.register_parser('.log')\ndef read(content, doc_id, source):\n    return []\n@registry.register_format('lines')\ndef lines(df):\n    return df.selectExpr('id as value')\n")
    assert registry.load_plugins([str(tmp_path / "own.py")]) and not registry.load_plugins([str(tmp_path / "own.py")])
    assert registry.summary() == {"tasks": [], "formats": ["lines"], "parsers": [".log"]}
    registry.clear()
    with pytest.raises(ValueError):
        registry.load_plugins([str(tmp_path / "absent.py")])
    registry.register_functions(spark)
    assert spark.sql("SELECT dl_tokens_estimate('12345678') AS n").first()["n"] == 2


PAPER = "# Pump Study\n\n## 1 Setup\n\n{0} Pump raises the water of the Grand Basin by 12.5 metres in every test that was run. The {0} Valve closes after 30 seconds when the pressure falls below 4 bar in the line.\n\n## 2 Results\n\nOn the Grand Basin the {0} Pump used 41 kWh, while the Old Rotor used 58 kWh in the same week. Staff moved the {0} Valve to the upper deck after two incidents in March.\n"


def test_pipeline_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name in ("Alpha", "Beta", "Gamma", "Delta"):
        (tmp_path / "in" / f"{name}.md").write_text(PAPER.format(name))
    (tmp_path / "in" / "bad.docx").write_text("no zip")
    made = config.build(config.Config, {"cache": str(tmp_path / "cache"), "formats": ["chatml", "dpo", "raw"], "generation": {"tasks": ["qa", "multihop", "multiturn"]}})
    report = Pipeline(spark, made).run(str(tmp_path / "in"), str(tmp_path / "out"))
    assert report["documents"] == 4 and len(report["skipped"]) == 1 and report["final"] > 0 and report["errors"] == {}
    raw = files.read_dataset(spark, str(tmp_path / "out" / "raw.jsonl"))
    assert raw.count() == report["final"] and raw.where("prov.verification is not null").count() == report["final"]
    again = Pipeline(spark, made).run(str(tmp_path / "in"), str(tmp_path / "out2"))
    assert again["final"] == report["final"] and again["cache"]["hits"] >= 4
    passages = files.read_corpus(spark, str(tmp_path / "out"))
    out = evaluate.answers(passages, spark.createDataFrame([(1, "How much did the Old Rotor use in the week?"), (2, "zzz qqq")], "query int, question string"), Offline()).collect()
    assert {r["query"]: r["refused"] for r in out} == {1: False, 2: True} and [r for r in out if r["query"] == 1][0]["citations"]
    graded = evaluate.evaluate(raw, Offline())
    assert evaluate.summary(graded).where("task is null").first()["n"] == report["final"]
    with pytest.raises(ValueError):
        evaluate.evaluate(raw, Offline(), "other")
    assert cli.main(["init", str(tmp_path / "c.json")]) == 0 and config.load(str(tmp_path / "c.json"))
    (tmp_path / "wrong.json").write_text('{"chunkin": {}}')
    assert cli.main(["--config", str(tmp_path / "wrong.json"), "plan", "x"]) == 2 and "did you mean 'chunking'" in capsys.readouterr().err


def test_streams(spark, tmp_path):
    rows = [(i, f"2025-01-01 {10 + i // 20:02d}:{(i % 20) * 3:02d}:00", i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, t string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    df.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), df.schema)
    query = incremental.event_windows(incremental.unseen(stream, "event_id", "30 minutes"), late=None).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    batch = {(r["start"], r["event_type"]): r["n"] for r in incremental.event_windows(df).collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    assert incremental.user_sessions(df, "10 minutes").count() == 3
    incremental.grow(stream, lambda b: b.select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "c2"), "event_id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_cross_document_seeds_equal_those_of_the_graph(spark, tmp_path, monkeypatch):
    """the query made all mentions, entities and edges of the graph, and wrote out the sources of one end of every link."""
    draw = random.Random(6)
    names = ["Pump Alpha", "Pump-Alpha", "Valve", "Valves", "VALVE", "High Rotor Frame", "HRF", "Basin", "Gasket Seal", "Deck", "Cooling Loop", "COOLING LOOP"] + [f"Part{i} Unit" for i in range(30)]
    rows = []
    for i in range(150):
        text = " and ".join(draw.choice(names) + draw.choice([" holds", " 5 ms", " 12 %"]) for _ in range(draw.randint(0, 4)))
        rows.append((f"c{i % 145}", None if i % 145 % 7 == 0 else f"s{i % 145 % 40}", text if i % 145 % 50 else None, draw.choice([None, [], ["Intro"], ["Main Body", "x"], [f"Root{i % 9}"]])))
    rows = list({r[0]: r for r in rows}.values())
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "id string, source string, text string, section_path array<string>")
    full = sorted(map(tuple, graph.cross_document(*graph.build(frame.dropDuplicates(["id"])), 1000).collect()))
    assert len(full) > 40 and any(a != b for a, b, *_ in full)
    monkeypatch.setattr(graph, "build", None)
    for limit in (1000, 9):
        got = [tuple(r) for r in graph.cross_document_seeds(frame, limit).collect()]
        assert got == sorted(full, key=lambda r: (-r[2], -r[3], r[0], r[1]))[:limit]
    frame.write.parquet(str(tmp_path / "chunks.parquet"))
    assert [tuple(r) for r in QUERIES["cross_document"](spark, str(tmp_path)).collect()] == sorted(full, key=lambda r: (-r[2], -r[3], r[0], r[1]))[:32]


def test_only_the_terms_asked_for_are_written(spark, monkeypatch):
    """F2 (a part of it): all postings of all passages were shuffled and written."""
    written, keep = [], retrieve.cut
    monkeypatch.setattr(retrieve, "cut", lambda df: written.append(df) or keep(df))
    rows = [(i, f"pump {'valve ' * (i % 3)} basin{i} rotor deck{i} seal") for i in range(30)] + [(30, None)]
    passages = spark.createDataFrame(rows, "id int, text string")
    queries = spark.createDataFrame([(1, "Valve basin7 nowhere")], "q int, text string")
    for listed in (1 << 20, 0):
        monkeypatch.setattr(retrieve, "LISTED", listed, raising=False)
        got = {r["id"]: r["lexical"] for r in retrieve.bm25(passages, queries, "id", "text", "q", "text").collect()}
        assert set(got) == {i for i in range(30) if i % 3} | {7} and max(got, key=got.get) == 7
    assert max(df.count() for df in written if "tf" in df.columns) == 21

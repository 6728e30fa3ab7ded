"""The verb on small tables, with a log of the calls that were made."""

import json
import os
import uuid

import pandas as pd
import pytest
from pydantic import BaseModel, Field, field_validator

from rowforge import enrich, enrich_with_stats, read_table
from rowforge.operators.executor import Throttle
from rowforge.operators.state import Checkpoint, save_table
from rowforge.providers import RuleProvider
from rowforge.search import CorpusSearch, get_provider, register_provider


class One(BaseModel):
    a: str


class Two(BaseModel):
    a: str
    b: str


class Logged:
    """A rule that writes a line for each call; the file is seen by all workers."""

    def __init__(self, path, value=None):
        self.path, self.value = path, value

    def provider(self, *fields, fail=None):
        path, value = self.path, self.value

        def rule(text, known, prompt):
            with open(path, "a") as f:
                f.write(json.dumps(text) + "\n")
            return value or f"{text}!"

        return RuleProvider(dict.fromkeys(fields, rule), fail)

    @property
    def calls(self):
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return sorted(json.loads(line) for line in f)


@pytest.fixture
def log(tmp_path):
    return Logged(str(tmp_path / "calls"))


def table(spark, rows, schema="id long, texto string"):
    return spark.createDataFrame(rows, schema)


def test_calls_once_for_each_row(spark, log):
    docs = table(spark, [(i, f"t{i}") for i in range(20)])
    out, s = enrich_with_stats(docs, One, "p", provider=log.provider("a"), parallel_requests=4)
    assert out.count() == 20 and {r["a"] for r in out.collect()} == {f"t{i}!" for i in range(20)}
    assert len(log.calls) == 20 and s.calls == 20 and s.rows == 20  # two actions, one call each
    assert out.columns == ["id", "texto", "a", "_input_tokens", "_output_tokens", "_reasoning_tokens"]


def test_resume(spark, log):
    docs = table(spark, [(1, "x", "old", "processed", None), (2, "y", None, "error", "e"), (3, "z", None, None, None)], "id long, texto string, a string, _status string, _error_details string")
    out = {r["id"]: r for r in enrich(docs, One, "p", provider=log.provider("a")).collect()}
    assert log.calls == ["z"] and out[1]["a"] == "old" and out[2]["_error_details"] == "e" and out[3]["a"] == "z!"
    out = enrich(docs, One, "p", provider=log.provider("a"), retry_errors=True)
    assert log.calls == ["y", "z", "z"] and "_status" not in out.columns  # an old error is cleared
    with pytest.warns(UserWarning):
        same = enrich(docs, One, "p", provider=log.provider("a"), resume=False)
    assert same.columns == docs.columns and len(log.calls) == 3


def test_reprocess(spark, log):
    docs = table(spark, [(1, "x", "A", "B", "processed"), (2, "y", None, None, None)], "id long, texto string, a string, b string, _status string")
    out = {r["id"]: r for r in enrich(docs, Two, "p", provider=log.provider("a", "b"), reprocess_columns=["a"]).collect()}
    assert (out[1]["a"], out[1]["b"], out[2]["a"], out[2]["b"]) == ("x!", "B", "y!", "y!")

    def fail(text):
        raise ValueError("no")

    out = {r["id"]: r for r in enrich(docs, Two, "p", provider=RuleProvider({}, fail), reprocess_columns="a", max_retries=1).collect()}
    assert out[1]["a"] == "A" and out[1]["_status"] == "error" and out[2]["a"] is None


def test_errors_stay_in_their_rows(spark):
    def fail(text):
        if text == "bad":
            raise KeyError("bad")
        if text == "auth":
            raise RuntimeError("401")

    docs = table(spark, [(1, "ok"), (2, "bad"), (3, "auth"), (4, None)])
    p = RuleProvider({"a": lambda t: t}, fail)
    out = {r["id"]: r for r in enrich(docs, One, "p", provider=p, base_delay=0, parallel_requests=2).collect()}
    assert out[1]["a"] == "ok" and out[1]["_status"] == "processed"
    assert out[2]["_error_details"] == "[Falhou após 3 tentativa(s)] KeyError: 'bad'"
    assert out[3]["_error_details"] == "[Erro não-recuperável] RuntimeError: 401"
    assert out[4]["_error_details"] == "null text"
    assert {r["a"] for r in enrich(docs.where("id = 4"), One, "p", provider=p, null_text="text").collect()} == {"None"}


class Strict(BaseModel):
    a: str

    @field_validator("a")
    @classmethod
    def short(cls, v):
        if len(v) > 3:
            raise ValueError("too long")
        return v


def test_validators_run(spark):
    out = enrich(table(spark, [(1, "abc"), (2, "abcd")]), Strict, "p", provider=RuleProvider({"a": lambda t: t}), max_retries=1)
    assert {r["id"]: r["_status"] for r in out.collect()} == {1: "processed", 2: "error"}


def test_duplicate_texts_share_a_call(spark, log):
    docs = table(spark, [(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")])
    out = {r["id"]: r["a"] for r in enrich(docs, One, "p", provider=log.provider("a"), dedup_calls=True).collect()}
    assert log.calls == ["x", "y"] and out == {1: "x!", 2: "x!", 3: None, 4: None, 5: "y!"}


@pytest.mark.parametrize("ending", ["csv", "parquet"])
def test_checkpoint(spark, log, tmp_path, ending):
    path = str(tmp_path / f"out.{ending}")
    docs = table(spark, [(i, f"t{i}") for i in range(5)])
    armed = str(tmp_path / "armed")
    open(armed, "w").close()

    def stop(text):
        if text == "t3" and os.path.exists(armed):
            raise SystemExit("killed")

    options = {"batch_size": 2, "checkpoint_path": path, "key": "id"}
    with pytest.raises(Exception):  # noqa: B017
        enrich(docs, One, "p", provider=log.provider("a", fail=stop), **options)
    assert Checkpoint(spark, path, "id").done(spark.createDataFrame([], "id long").schema).count() == 2
    os.remove(armed)
    before = len(log.calls)
    out = enrich(docs, One, "p", provider=log.provider("a", fail=stop), **options)
    assert sorted((r["id"], r["a"]) for r in out.collect()) == [(i, f"t{i}!") for i in range(5)]
    assert len(log.calls) - before == 3  # t2, t3 and t4; the first batch was durable
    back = read_table(path, spark=spark)
    assert back.count() == 5 and set(back.columns) >= {"a", "_status"} and not os.path.exists(f"{path}.batches")
    again = enrich(back, One, "p", provider=log.provider("a"), text_column="texto")
    assert again.count() == 5 and len(log.calls) - before == 3
    with pytest.raises(ValueError, match="key"):
        enrich(docs, One, "p", provider=log.provider("a"), batch_size=2, checkpoint_path=path)


class Drug(BaseModel):
    name: str
    status: str | None = Field(None, json_schema_extra={"search_depth": "advanced"})


class Recipe(BaseModel):
    drugs: list[Drug]
    kind: str = ""
    detail: str | None = Field(None, json_schema_extra={"condition": {"field": "kind", "equals": "long"}, "prompt_append": "x"})


SEARCH = {"use_search": True, "search_provider": "corpus", "search_per_field": True}


def test_items_conditions_and_traces(spark):
    p = RuleProvider({"drugs": lambda t: [{"name": w} for w in t.split()], "status": lambda t, k, prompt: prompt.split("name: ")[1].split("\n")[0].upper(), "kind": lambda t: "long" if len(t) > 5 else "short", "detail": "d"})
    docs = table(spark, [(1, "aa bb cc"), (2, "aa")])
    out = {r["id"]: r for r in enrich(docs, Recipe, "p {texto}", provider=p, save_trace="full", **SEARCH).collect()}
    assert [(d["name"], d["status"]) for d in out[1]["drugs"]] == [("aa", "AA"), ("bb", "BB"), ("cc", "CC")]
    assert (out[1]["detail"], out[2]["detail"]) == ("d", None)
    assert out[1]["_search_credits"] == 6 and out[2]["_search_credits"] == 3  # lists, items, kind, and detail where it is asked
    assert len(json.loads(out[1]["_trace_drugs_items"])) == 3 and out[2]["_trace_detail"] is None
    assert json.loads(out[1]["_trace_kind"])["messages"][0]["content"].startswith("p aa bb cc")


def test_single_search_and_custom_provider(spark):
    register_provider(CorpusSearch(["alpha beta", "gamma"]))
    assert get_provider("corpus").create_tool(5)("BETA") == ["alpha beta"]
    out = enrich(table(spark, [(1, "x")]), One, "p", provider=RuleProvider({"a": "v"}, reasoning=2), use_search=True, search_provider="corpus", save_trace=True)
    r = out.first()
    assert out.columns == ["id", "texto", "a", "_trace", "_search_credits", "_input_tokens", "_output_tokens", "_reasoning_tokens"]
    assert r["_reasoning_tokens"] == 2 and json.loads(r["_trace"])["search_queries"] == ["a"]


def test_a_provider_of_ones_own_reaches_the_workers(spark):
    """A name that the package does not know, registered or given as an object; its tool is called with the query."""
    mine = CorpusSearch(["alpha beta", "gamma", "beta"], "mine")
    register_provider(mine)
    rules = RuleProvider({"a": lambda text, known, prompt, found: ";".join(found)}, query=lambda text, names: text)
    rows = table(spark, [(1, "beta"), (2, "gamma"), (3, "delta")])
    for given in ("mine", CorpusSearch(["alpha beta", "gamma", "beta"], "other")):
        out = enrich(rows, One, "p", provider=rules, use_search=True, search_provider=given, save_trace=True, parallel_requests=3)
        assert {r["id"]: r["a"] for r in out.collect()} == {1: "alpha beta;beta", 2: "gamma", 3: ""}
        assert {json.loads(r["_trace"])["search_queries"][0] for r in out.collect()} == {"beta", "gamma", "delta"}
        assert "_error_details" not in out.columns and {r["_search_credits"] for r in out.collect()} == {1}


def stand_in(monkeypatch, name, **members):
    """A module of this name, and its parents, for as long as a test runs."""
    import importlib.machinery
    import sys
    import types

    parts = name.split(".")
    for i in range(1, len(parts) + 1):
        at = ".".join(parts[:i])
        if at not in sys.modules:
            module = types.ModuleType(at)
            module.__spec__ = importlib.machinery.ModuleSpec(at, None)
            module.__path__ = []
            monkeypatch.setitem(sys.modules, at, module)
    for k, v in members.items():
        setattr(sys.modules[name], k, v)


def test_langchain_client(monkeypatch):
    """Structured answers, their usage, model arguments, and an agent that gets the search provider's tool."""
    from rowforge.options import checked
    from rowforge.providers import find_provider

    made, agents = {}, []

    class Llm:
        def with_structured_output(self, model, include_raw):
            assert include_raw
            raw = type("Raw", (), {"usage_metadata": {"input_tokens": 3, "output_tokens": 2, "total_tokens": 5, "output_token_details": {"reasoning": 1}}})()
            return type("S", (), {"invoke": lambda self, prompt: {"raw": raw, "parsed": None if "none" in prompt else model(a=prompt.upper()), "parsing_error": "odd" if "bad" in prompt else None}})()

    class Agent:
        def __init__(self, tools, response_format):
            self.tools, self.model = tools, response_format

        def invoke(self, given):
            found = self.tools[0]("beta")
            return {"structured_response": self.model(a=found[0]), "messages": [{"type": "ai", "tool_calls": [{"name": "mine_search", "args": {"query": "beta"}}]}]}

    def create_agent(llm, tools, response_format):
        agents.append(1)
        return Agent(tools, response_format)

    stand_in(monkeypatch, "langchain.chat_models", init_chat_model=lambda model, model_provider, **settings: made.update(settings, model=model, provider=model_provider) or Llm())
    stand_in(monkeypatch, "langchain.agents", create_agent=create_agent)
    stand_in(monkeypatch, "langchain_core")
    stand_in(monkeypatch, "langchain_openai")
    _, o = checked(One, "p {texto}", provider="openai", model="m", api_key="k", model_kwargs={"temperature": 1, "seed": 4}, use_search=True, search_provider=CorpusSearch(["alpha beta"], "mine"))
    provider = find_provider("openai")
    provider.check(o)
    client = provider.open(o)
    assert made == {"temperature": 1, "api_key": "k", "seed": 4, "model": "m", "provider": "openai"}
    answer = client.ask("p x", One, "x", {})
    assert answer.data.a == "P X" and answer.usage["total_tokens"] == 5 and answer.usage["reasoning_tokens"] == 1
    for prompt in ("bad", "none"):
        with pytest.raises(ValueError):
            client.ask(prompt, One, "x", {})
    for _ in range(2):
        answer = client.search("p x", One, o.search, "x", {})
    assert answer.data.a == "alpha beta" and len(agents) == 1 and answer.messages[0]["tool_calls"]


def test_agent_sdk_client(monkeypatch, spark):
    """JSON by instruction in text blocks; the cost reaches the run's totals."""
    from rowforge.operators.executor import Run
    from rowforge.options import checked
    from rowforge.plans.planner import compile_plan
    from rowforge.providers import find_provider

    class Text:
        def __init__(self, text):
            self.text = text

    class Said:
        def __init__(self, content):
            self.content = content

    class Done:
        total_cost_usd = 0.25

    class Settings:
        def __init__(self, **given):
            self.given = given

    asked = []

    async def query(prompt, options):
        asked.append((prompt, options.given))
        yield Said([Text('Here: {"a": '), object(), Text('"v"}')])
        yield Done()

    stand_in(monkeypatch, "claude_agent_sdk", query=query, AssistantMessage=Said, ResultMessage=Done, TextBlock=Text, ClaudeAgentOptions=Settings)
    model, o = checked(One, "p {texto}", provider="agent_sdk", model="m", model_kwargs={"max_turns": 2})
    provider = find_provider("agent_sdk")
    provider.check(o)
    run = Run(compile_plan(model, o), o, provider.open(o), {})
    run("x")
    assert run.data == {"a": "v"} and run.usage["cost_usd"] == 0.25 and asked[0][0] == "p x"
    assert asked[0][1]["max_turns"] == 2 and asked[0][1]["model"] == "m" and '"a"' in asked[0][1]["system_prompt"]
    with pytest.raises(ValueError):
        checked(One, "p", provider="agent_sdk", use_search=True)


def test_polars_and_excel_by_stand_ins(spark, monkeypatch, tmp_path):
    class Frame:
        def __init__(self, data):
            self.data = data

        def to_pandas(self):
            return pd.DataFrame(self.data)

    class Series:
        name = "s"

        def __init__(self, data, name="s"):
            self.data, self.name = list(data), name

        def to_list(self):
            return self.data

    for kind, name in ((Frame, "DataFrame"), (Series, "Series")):
        kind.__name__, kind.__module__ = name, "polars.frame"
    stand_in(monkeypatch, "polars", DataFrame=Frame, Series=Series, from_pandas=lambda x: x)
    p = RuleProvider({"a": lambda t: t.upper()})
    f = enrich(Frame({"texto": ["b", "a"], "k": [1, 2]}), One, "p", provider=p, spark=spark, track_tokens=False)
    assert list((f.to_pandas() if isinstance(f, Frame) else f)["a"]) == ["B", "A"]
    s = enrich(Series(["x", "y"]), One, "p", provider=p, spark=spark, track_tokens=False)
    assert list((s.to_pandas() if isinstance(s, Frame) else s)["a"]) == ["X", "Y"]
    for ending, package in (("xls", "xlrd"), ("xlsx", "openpyxl")):
        open(f"{tmp_path}/t.{ending}", "wb").close()
        stand_in(monkeypatch, package)
        monkeypatch.setattr(pd, "read_excel", lambda path, **k: pd.DataFrame({"texto": ["x"], "n": [1]}))
        assert read_table(f"{tmp_path}/t.{ending}", spark=spark).first()["texto"] == "x"


def test_users_see_what_went_wrong(spark):
    def fail(text):
        if text == "b":
            raise RuntimeError("429 too many requests")

    with pytest.warns(UserWarning, match="1 of 2 rows are in error") as seen:
        out, stats = enrich_with_stats(table(spark, [(1, "a"), (2, "b")]), One, "p", provider=RuleProvider({"a": "v"}, fail), max_retries=1, base_delay=0.0, parallel_requests=2)
    assert any("too many requests" in str(w.message) and "parallel_requests" in str(w.message) for w in seen)
    assert stats.errors == 1 and "429" in stats.error and out.where("_status = 'error'").count() == 1
    kept = enrich(table(spark, [(1, "a")]), One, "p", provider=RuleProvider({"a": "v"}), keep_status=True)
    assert "_status" in kept.columns and "_error_details" in kept.columns


class Listed(BaseModel):
    tags: list[str]


def test_files_and_resumed_tables_keep_cells_that_do_not_parse(spark, tmp_path):
    spark.createDataFrame([("t", '["a"]', "processed"), ("u", "not json", "processed")], "texto string, tags string, _status string").write.parquet(f"{tmp_path}/t.parquet")
    rows = read_table(f"{tmp_path}/t.parquet", Listed, spark=spark)
    assert {(tuple(r["tags"] or ()), r["tags_raw"]) for r in rows.collect()} == {(("a",), None), ((), "not json")}
    out = enrich(spark.read.parquet(f"{tmp_path}/t.parquet"), Listed, "p", provider=RuleProvider({"tags": ["z"]}), keep_status=True)
    assert {(tuple(r["tags"] or ()), r["tags_raw"]) for r in out.collect()} == {(("a",), None), ((), "not json")}
    # a variant passes through the calls
    mixed = spark.createDataFrame([("t", "[1]"), ("u", "words")], "texto string, extra string").write.parquet(f"{tmp_path}/m.parquet")
    assert mixed is None
    out = enrich(read_table(f"{tmp_path}/m.parquet", spark=spark), One, "p", provider=RuleProvider({"a": "v"}), track_tokens=False)
    assert dict(out.dtypes)["extra"] == "variant" and out.count() == 2


def test_many_tasks_where_all_cores_are_used(spark, monkeypatch):
    from rowforge.operators import executor
    from rowforge.options import checked
    from rowforge.plans.planner import compile_plan

    monkeypatch.setattr(executor, "TASK_ROWS", 10)
    rows, cores = spark.range(400).selectExpr("id", "cast(id as string) AS texto"), spark.sparkContext.defaultParallelism
    for parallel, tasks in ((1, 1), (cores, -(-400 // (cores * 10)) * cores), (2 * cores, -(-400 // (cores * 10)) * cores)):
        model, o = checked(One, "p", provider=RuleProvider({"a": "v"}), parallel_requests=parallel)
        assert executor.execute(rows, "texto", compile_plan(model, o), o).rdd.getNumPartitions() == tasks


def test_containers(spark):
    p = RuleProvider({"a": lambda t: t.upper()})
    s = enrich(pd.Series(["x", "y"], index=["i", "j"], name="n"), One, "p", provider=p, spark=spark)
    assert list(s.index) == ["i", "j"] and list(s["a"]) == ["X", "Y"] and "_texto" not in s.columns
    f = enrich(pd.DataFrame({"texto": ["b", "a"], "k": [1, 2]}, index=[7, 3]), One, "p", provider=p, spark=spark)
    assert list(f.index) == [7, 3] and list(f["a"]) == ["B", "A"] and list(f.columns[:2]) == ["texto", "k"]
    d = enrich({"u": "x", "v": "y"}, One, "p", provider=p, spark=spark, track_tokens=False)
    assert list(d.index) == ["u", "v"] and list(d.columns) == ["a"]
    assert list(enrich(["q"], One, "p", provider=p, spark=spark)["a"]) == ["Q"]
    with pytest.raises(TypeError):
        enrich(5, One, "p", provider=p, spark=spark)


class Rich(BaseModel):
    tags: list[str]
    counts: dict[str, int]
    pair: tuple[str, float]


def test_files_keep_complex_columns(spark, tmp_path):
    p = RuleProvider({"tags": ["a", 'b"c'], "counts": {"x": 1}, "pair": ("sim", 2.5)})
    out = enrich(table(spark, [(1, "t\nu")]), Rich, "p", provider=p)
    for ending in ("csv", "parquet"):
        path = str(tmp_path / f"t.{ending}")
        save_table(out, path)
        r = read_table(path, Rich, spark=spark).first()
        assert r["tags"] == ["a", 'b"c'] and r["counts"] == {"x": 1} and r["texto"] == "t\nu"
    with open(tmp_path / "t.json", "w") as f:
        json.dump([{"a": 1, "b": "[1, 2]"}], f)
    assert dict(read_table(str(tmp_path / "t.json"), spark=spark).dtypes) == {"a": "bigint", "b": "array<bigint>"}
    assert dict(read_table(str(tmp_path / "t.json"), normalize=False, spark=spark).dtypes)["b"] == "string"
    with pytest.raises(FileNotFoundError):
        read_table(str(tmp_path / "no.csv"), spark=spark)
    (tmp_path / "t.txt").write_text("x")
    with pytest.raises(ValueError):
        read_table(str(tmp_path / "t.txt"), spark=spark)
    with pytest.raises(ValueError):
        save_table(out, str(tmp_path / "t.txt"))


def test_status_column_of_another_name_stays(spark):
    out = enrich(table(spark, [(1, "x")]), One, "p", provider=RuleProvider({"a": "v"}), status_column="st")
    assert "st" in out.columns and out.first()["st"] == "processed"


def test_throttle_halves():
    t = Throttle(10, 0, pause=0)
    seen = []
    for _ in range(4):
        t.hit()
        seen.append(t.workers)
    assert seen == [5, 2, 1, 1]


def test_report(spark):
    def fail(text):
        if text == "x":
            raise RuntimeError("429")

    s = enrich_with_stats(table(spark, [(1, "x"), (2, "yyyyyyyy")]), One, "p", provider=RuleProvider({"a": "v"}, fail, reasoning=3), max_retries=1, parallel_requests=8)[1]
    assert (s.rows, s.errors, s.input_tokens, s.output_tokens, s.reasoning_tokens) == (2, 1, 2, 1, 3)
    text = s.report("m", "exa")
    assert "RPM" in text and "reasoning: 3" in text


def test_only_pending_rows_reach_the_operator(spark):
    docs = spark.createDataFrame([(1, "x", "processed")], "id long, texto string, _status string")
    path = f"/tmp/rowforge-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    from rowforge.operators.executor import execute
    from rowforge.operators.state import pending, set_up_columns
    from rowforge.functions.schema import struct_of
    from rowforge.options import checked
    from rowforge.plans.planner import compile_plan

    model, o = checked(One, "p", provider=RuleProvider({"a": "v"}))
    plan = compile_plan(model, o)
    ready = set_up_columns(spark.read.parquet(path), plan, o, struct_of(model))
    shown = execute(ready.where(pending(o)), "texto", plan, o)._jdf.queryExecution().executedPlan().toString()
    assert shown.index("MapInArrow") < shown.index("Filter") and "PushedFilters: [" in shown

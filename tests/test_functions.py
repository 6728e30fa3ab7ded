"""Pure parts: types, conditions, plans, prompts, errors, usage, options."""

import random
import warnings
from typing import Any, Literal, Optional, Union

import pytest
from pydantic import BaseModel, Field
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge import errors as E
from rowforge import normalize_value
from rowforge import options as O
from rowforge.functions import conditions as C
from rowforge.functions import schema as S
from rowforge.functions import text as X
from rowforge.functions import usage as U
from rowforge.operators.enrich import slices
from rowforge.operators.executor import concurrency
from rowforge.operators.state import ordered
from rowforge.plans import planner as P
from rowforge.providers import RuleProvider
from rowforge.search import ExaProvider, SearchProvider, TavilyProvider, get_available_providers, get_provider, register_provider


class Leaf(BaseModel):
    a: str
    b: int | None = None


class Tree(BaseModel):
    name: str
    children: list["Tree"] = []


class Every(BaseModel):
    s: str
    i: int
    f: float
    b: bool
    lit: Literal["x", "y"]
    num: Literal[1, 2]
    opt: Optional[int]
    items: list[str]
    raw: list[dict]
    counts: dict[str, int]
    bare: dict
    pair: tuple[str, float]
    many: tuple[int, ...]
    leaf: Leaf
    leaves: list[Leaf]
    tree: Tree
    mixed: Union[int, str]
    maybe: list[str] | None
    anything: Any


def test_types():
    got = {f.name: f.dataType.simpleString() for f in S.struct_of(Every).fields}
    assert got == {
        "s": "string", "i": "bigint", "f": "double", "b": "boolean", "lit": "string", "num": "bigint", "opt": "bigint", "items": "array<string>", "raw": "string",
        "counts": "map<string,bigint>", "bare": "string", "pair": "struct<_1:string,_2:double>", "many": "array<bigint>", "leaf": "struct<a:string,b:bigint>",
        "leaves": "array<struct<a:string,b:bigint>>", "tree": "string", "mixed": "string", "maybe": "array<string>", "anything": "string",
    }
    assert S.complex_fields(Every) == {"items", "raw", "counts", "bare", "pair", "many", "leaves", "maybe"}
    assert S.list_item_model(Optional[list[Leaf]]) is Leaf and S.list_item_model(list[str]) is None
    assert S.models_in(dict[str, list[Leaf]] | None) == [Leaf]
    with pytest.raises(ValueError):
        S.struct_of(type("Empty", (BaseModel,), {}))


def test_cells():
    kinds = S.struct_of(Every)
    assert S.cell({"k": "é"}, kinds["bare"].dataType) == '{"k": "é"}'
    assert S.cell(("a", 1.0), kinds["pair"].dataType) == {"_1": "a", "_2": 1.0}
    assert S.cell({"x": 1}, kinds["counts"].dataType) == [("x", 1)]
    assert S.cell([{"a": "q"}], kinds["leaves"].dataType) == [{"a": "q", "b": None}]
    assert S.cell(5, kinds["mixed"].dataType) == "5"


VALUES = ["pf", "pj", None]
CONDITIONS = [{"field": "v", op: x} for op, x in [("equals", "pf"), ("equals", None), ("not_equals", "pf"), ("not_equals", None), ("in", ["pf", "q"]), ("in", [None]), ("in", []), ("not_in", ["pf"]), ("not_in", [None, "pj"]), ("exists", True), ("exists", False)]]


def test_conditions_agree(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for c in CONDITIONS:
        got = {r["v"]: r["h"] for r in rows.select("v", C.condition_column(c, rows.schema).alias("h")).collect()}
        assert got == {v: C.holds(c, {"v": v}) for v in VALUES}, c
    deep = spark.createDataFrame([({"b": "x"}, '{"c": {"d": "y"}}')], T.StructType.fromDDL("m map<string,string>, j string"))
    for path, want in [("m.b", True), ("m.z", False), ("j.c.d", True), ("j.c.q", False), ("no.b", False)]:
        assert deep.select(C.condition_column({"field": path, "exists": True}, deep.schema).alias("h")).first()[0] is want
    with pytest.raises(TypeError):
        C.condition_column(lambda d: True, rows.schema)


def test_conditions():
    data = {"a": {"b": {"c": 1}}, "n": None}
    assert C.nested_value(data, "a.b.c") == 1 and C.nested_value(data, "a.x.c") is None and C.nested_value(data, "n.x") is None
    assert C.holds(None, {}) and C.holds(lambda d: d["a"], data) and not C.skipped(None, {}) and not C.skipped({}, {})
    for bad in ({"equals": 1}, {"field": "a"}, 5, {"field": "a", "in": "abc"}, lambda d: 1 / 0):
        with pytest.warns(UserWarning):
            assert not C.holds(bad, data)
    assert C.holds({"field": "x", "not_equals": 1}, {}) and C.holds({"field": "a.b.c", "equals": 1, "exists": False}, data)


def fields(**conditions):
    return {n: P.field_config({"condition": c} if c else None) for n, c in conditions.items()}


def test_order():
    needs = {n: P.dependencies(n, c) for n, c in fields(c={"field": "b", "exists": True}, b={"field": "a.x", "equals": 1}, a=None, z=None).items()}
    assert needs == {"c": ["b"], "b": ["a"], "a": [], "z": []}
    assert P.execution_order(needs) == ["a", "b", "c", "z"]
    with pytest.raises(ValueError, match="a -> b -> a"):
        P.execution_order({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError, match="nope"):
        P.execution_order({"a": ["nope"]})
    double = P.field_config({"condition": {"field": "a", "exists": True}, "depends_on": ["a.x", "a"]})
    assert P.execution_order({"a": [], "b": P.dependencies("b", double)}) == ["a", "b"]
    with pytest.warns(UserWarning):
        P.dependencies("x", P.field_config({"depends_on": ["a"]}))
    with pytest.warns(UserWarning):
        P.dependencies("x", P.field_config({"condition": bool}))


def test_order_of_random_graphs():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        needs = {str(i): [str(j) for j in range(n) if j != i and rng.random() < 0.15] for i in range(n)}
        if cycle := P.find_cycle(needs):
            assert cycle[0] == cycle[-1] and all(b in needs[a] for a, b in zip(cycle, cycle[1:], strict=False))
        else:
            order = P.execution_order(needs)
            assert all(order.index(d) < order.index(f) for f in needs for d in needs[f])


class Info(BaseModel):
    status: str | None = Field(None, description="status atual", json_schema_extra={"search_depth": "advanced", "max_results": 3})
    other: str = ""


class Order(BaseModel):
    info: Info
    amount: int = 0


class Sheet(BaseModel):
    orders: list[Order] = []
    note: str = Field("", description="uma nota", json_schema_extra={"prompt_append": "Seja breve."})
    own: str = Field("", json_schema_extra={"prompt": "Só isto: {texto}"})
    info: Info | None = None


def options(**more):
    more = {"provider": RuleProvider({}), "use_search": True, "search_provider": "corpus", "search_per_field": True} | more
    return O.checked(more.pop("model", Sheet), more.pop("prompt", "P {texto}"), **more)


def test_plan_by_field():
    plan = P.compile_plan(*options(save_trace=True))
    steps = {s.trace: s for s in plan.steps}
    assert list(steps) == ["orders", "note", "own", "info"]
    assert steps["note"].prompt == "P {texto}\n\nResponda APENAS o campo: note (uma nota)\n\nSeja breve."
    assert steps["own"].prompt == "Só isto: {texto}"
    (item,) = steps["orders"].items
    assert (item.path, item.fields, item.search.depth, item.search.max_results) == ("info.status", ("status",), "advanced", 3)
    (before,) = steps["info"].nested
    assert before.prompt == "Pesquise informações para preencher o campo 'info.status'\n\nResponda APENAS o campo: status (status atual)"
    assert plan.traces == ("_trace_orders", "_trace_orders_items", "_trace_note", "_trace_own", "_trace_info__status", "_trace_info")
    assert [n.path for n in P.configured_fields(Sheet)] == ["orders.info.status", "note", "own", "info.status"]


def test_plan_by_group():
    class Four(BaseModel):
        a: str
        b: str
        c: str
        d: str

    groups = {"g": {"fields": ["a", "c"], "prompt": "Busque {query}", "max_results": 9}, "h": {"fields": ["d"]}}
    plan = P.compile_plan(*options(model=Four, search_groups=groups))
    assert [(s.kind, s.fields) for s in plan.steps] == [("group", ("a", "c")), ("group", ("d",)), ("field", ("b",))]
    assert plan.steps[0].prompt == "Busque {texto}\n\nTexto: {texto}" and plan.steps[0].search.max_results == 9
    assert plan.steps[1].prompt == "P {texto}\n\nResponda os campos: d"
    for bad in ({"g": {}}, {"g": {"fields": []}}, {"g": {"fields": ["x"]}}, {"g": {"fields": ["a"]}, "h": {"fields": ["a"]}}, {"g": {"fields": ["a"], "max_results": 21}}, {"g": 5}):
        with pytest.raises(ValueError):
            options(model=Four, search_groups=bad)
    with pytest.raises(ValueError):
        options(search_groups={"g": {"fields": ["note"]}})
    with pytest.raises(ValueError):
        options(model=Four, search_groups={"g": {"fields": ["a"]}}, search_per_field=False)
    with pytest.raises(ValueError, match="search_depth"):
        O.check_groups({"g": {"fields": ["a"], "search_depth": "deep"}}, Four, True, True, "tavily")


def test_plan_needs_per_field():
    with pytest.raises(ValueError):
        P.compile_plan(*options(search_per_field=False))
    with pytest.raises(ValueError):
        P.compile_plan(*O.checked(Sheet, "P", provider=RuleProvider({})))
    assert P.has_field_config(Sheet) and not P.has_field_config(Leaf) and not P.has_field_config(Tree)


def test_nested_writes_and_item_text():
    x = {"a": 5}
    P.set_nested(x, "a.b.c", 1)
    P.set_nested(x, "d", 2)
    assert x == {"a": {"b": {"c": 1}}, "d": 2}
    assert P.item_context({"info": {"status": None}, "amount": 3}, Order) == "amount: 3"
    assert P.item_context({}, Order) == "item"


def test_prompts():
    assert X.template("Olá  \n") == "Olá\n\nTexto a analisar:\n{texto}"
    assert X.template("Veja {text}!") == "Veja {texto}!"
    assert X.build_prompt("{texto} {x} {texto}", "{texto}") == "{texto} {x} {texto}"


@pytest.mark.parametrize(
    ("reply", "want"),
    [('{"a": 1}', 1), ('Aqui:\n```json\n{"a": 2}\n```\nfim', 2), ('antes {"a": {"b": 3}} depois', {"b": 3}), ([{"type": "text", "text": '{"a": '}, "4}"], 4)],
)
def test_parse_json(spark, reply, want):
    assert X.parse_json(reply)["a"] == want
    if isinstance(reply, str):
        row = spark.createDataFrame([(reply,)], "r string").select(F.get_json_object(X.json_part(F.col("r")), "$.a").alias("a")).first()
        assert row["a"].replace(" ", "") == str(want).replace("'", '"').replace(" ", "")
    with pytest.raises(ValueError):
        X.parse_json("nada")
    assert X.parse_json(type("M", (), {"content": '{"a": 1}'})()) == {"a": 1}


def test_normalize(spark):
    assert normalize_value('  ["a"]') == ["a"] and normalize_value("[bad") == "[bad" and normalize_value(5) == 5 and normalize_value("x") == "x"
    rows = spark.createDataFrame([('["sim", 50000.0]', '["a"]', "t"), ('["nao", 0]', "[]", "[1]"), ("[]", None, None), ("{bad", "x", "u")], "p string, l string, t string")
    kinds = {"p": S.spark_type(tuple[str, float]), "l": S.spark_type(list[str]), "missing": T.LongType()}
    out = X.normalize_columns(rows, kinds, keep_raw=True).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in out] == [("sim", 50000.0), ("nao", 0.0), (None, None), None]
    assert [r["l"] for r in out] == [["a"], [], None, None] and out[3]["p_raw"] == "{bad" and out[3]["l_raw"] == "x"
    every = X.normalize_all(rows.select("l", "t").where("l is null or l <> 'x'"))
    # a column in which some cells are JSON and some are not: each cell by itself
    assert dict(every.dtypes) == {"l": "array<string>", "t": "variant"}
    assert [r["t"] for r in X.json_columns(every).collect()] == ['"t"', "[1]", None]


def test_normalize_all_loses_nothing(spark):
    cells = ['{"a": 1}'] * 10 + ['{"b": 2}', "plain words", '{"a": "x"}', "[bad", None, " [1, {}] "]
    rows = spark.createDataFrame([(i, c, '{"a": %d}' % i if i else '{"b": "y"}', "word") for i, c in enumerate(cells)], "i long, mixed string, same string, plain string")
    out = X.normalize_all(rows)
    assert dict(out.dtypes) == {"i": "bigint", "mixed": "variant", "same": "struct<a:bigint,b:string>", "plain": "string"}
    got = [r["m"] for r in out.select(F.to_json("mixed").alias("m")).collect()]
    assert got == ['{"a":1}'] * 10 + ['{"b":2}', '"plain words"', '{"a":"x"}', '"[bad"', None, "[1,{}]"]
    assert [(r["a"], r["b"]) for r in out.select("same.*").collect()] == [(None, "y"), *[(i, None) for i in range(1, len(cells))]]
    assert X.normalize_all(rows.limit(0)).dtypes == rows.dtypes and X.normalize_all(rows.select("i")).columns == ["i"]


def test_keep_unparsed(spark):
    rows = spark.createDataFrame([('["a"]', "[1]"), ("not json", "[2]")], "l string, m string")
    out = X.keep_unparsed(rows, {"l": S.spark_type(list[str]), "m": S.spark_type(list[int])})
    assert out.columns == ["l", "m", "l_raw"] and [(r["l"], r["l_raw"]) for r in out.collect()] == [(["a"], None), (None, "not json")]


def test_error_classes(spark):
    assert E.is_rate_limit(Exception("Error 429: Too many requests")) and not E.is_rate_limit(ValueError("Invalid argument"))
    assert E.is_recoverable(ValueError("parse")) and not E.is_recoverable(Exception("401"))
    assert not E.is_recoverable(Exception("row 14011")) and E.is_recoverable(Exception("row 14011"), whole_numbers=True)
    texts = ["X: 401", "Timeout: a", "X: exa quota", "X: example quota", "Y: 403", "Z: tavily api missing", "Z: network", "UsageLimitExceededError: q", "a: b"]
    rows = spark.createDataFrame([(t,) for t in texts], "m string")
    got = rows.select("m", E.error_kind_column(F.col("m")).alias("k"), E.recoverable_column(F.col("m")).alias("r"), E.rate_limit_column(F.col("m")).alias("l")).collect()
    for r in got:
        assert (r["k"], r["r"], r["l"]) == (E.error_kind(r["m"]), E.is_recoverable(r["m"]), E.is_rate_limit(r["m"]))
    assert E.error_kind("X: example quota") == "other" and E.error_kind("X: exa quota") == "search_quota"


def test_attempts():
    waits = []

    def run(outcomes, **more):
        left = list(outcomes)

        def call():
            x = left.pop(0)
            if isinstance(x, BaseException):
                raise x
            return x

        return E.attempt(call, sleep=waits.append, **more)

    assert run([1]).details() is None
    assert run([RuntimeError("503"), 1]).details() == "Sucesso após 1 retry(s)"
    out = run([RuntimeError("x")] * 5, most=5, base=1, longest=3)
    assert out.details() == "[Falhou após 5 tentativa(s)] RuntimeError: x"
    assert all(a <= w <= 1.1 * a for a, w in zip([1, 2, 3, 3], waits[1:], strict=True))
    assert run([Exception("401 x"), 1]).details() == "[Erro não-recuperável] Exception: 401 x"
    with pytest.raises(KeyboardInterrupt):
        run([KeyboardInterrupt()])
    with pytest.raises(ValueError):
        E.attempt(lambda: 1, most=0)


def test_provider_names():
    assert E.provider_info("google_genai") == E.ProviderInfo("Google Gemini", "langchain_google_genai", "langchain-google-genai", "GOOGLE_API_KEY")
    assert E.provider_info("openai").env == "OPENAI_API_KEY" and E.provider_info("bedrock").env is None
    assert E.provider_info("mistral").package == "langchain_mistralai" and E.provider_info("some_new").name == "Some New"
    assert E.provider_info(None).env == "API_KEY"
    with pytest.raises(ImportError, match="langchain"):
        E.check_provider("openai")
    assert "OPENAI_API_KEY" in E.friendly_message(Exception("401"), "openai") and "gcloud" in E.friendly_message(Exception("401"), "google_vertexai")
    assert "parallel_requests" in E.friendly_message(Exception("429")) and E.friendly_message(KeyError("x")).endswith("'x'")


def test_usage_and_traces():
    meta = {"input_tokens": 5, "output_tokens": 2, "total_tokens": 7, "output_token_details": {"reasoning": 1}}
    objects = type("U", (), {"input_tokens": 5, "output_tokens": 2, "total_tokens": 7, "output_token_details": type("D", (), {"reasoning": 1})()})()
    assert U.usage_of(meta) == U.usage_of(objects) and U.usage_of(meta)["reasoning_tokens"] == 1
    messages = [
        {"type": "ai", "content": "", "usage_metadata": meta, "tool_calls": [{"name": "tavily", "args": {"query": "q"}, "id": "1"}, {"name": "calc", "args": {}}, {"name": "web_search", "args": {"query": "r"}}]},
        {"type": "tool", "content": "secret", "tool_call_id": "1"},
        {"type": "ai", "content": "fim", "usage_metadata": meta},
    ]
    got = U.agent_usage(messages, TavilyProvider(), "advanced", 5)
    assert (got["input_tokens"], got["reasoning_tokens"], got["search_count"], got["search_credits"]) == (10, 2, 2, 4)
    trace = U.trace_of(messages, "m", 1.23456, "minimal", TavilyProvider())
    assert trace["search_queries"] == ["q", "r"] and trace["total_tool_calls"] == 2 and trace["duration_seconds"] == 1.235
    assert [m["content"] for m in trace["messages"]] == ["", "[omitted]", "fim"] and trace["messages"][1]["tool_call_id"] == "1"
    assert U.trace_of(messages, "m", 0, "full")["messages"][1]["content"] == "secret"
    assert ExaProvider().calculate_credits(3, max_results=26) == 15 and ExaProvider().calculate_credits(3, max_results=25) == 3


def test_search_registry():
    class Mine(SearchProvider):
        name = "mine"

        def create_tool(self, max_results, **options):
            return None

        def calculate_credits(self, search_count, **options):
            return 0

    register_provider(Mine())
    assert get_provider("mine").get_tool_name_pattern() == "mine" and {"tavily", "exa", "corpus", "mine"} <= set(get_available_providers())
    with pytest.raises(ValueError):
        get_provider("nope")
    assert get_provider("corpus").create_tool(1)("x") == []


def test_options():
    ok = {"provider": RuleProvider({})}
    for bad in (
        {"questions": None}, {"prompt": None}, {"max_retries": 0}, {"max_retries": True}, {"parallel_requests": 0}, {"batch_size": 1}, {"batch_size": True, "checkpoint_path": "a.csv"},
        {"batch_size": 1, "checkpoint_path": "a.txt"}, {"save_trace": True}, {"use_search": True, "search_provider": "zzz"}, {"use_search": True, "search_provider": "corpus", "max_results": 21},
        {"use_search": True, "search_provider": "corpus", "save_trace": "all"}, {"reprocess_columns": ["x"]}, {"null_text": "x"}, {"use_search": True, "provider": "agent_sdk"},
    ):
        with pytest.raises(ValueError):
            O.checked(**({"questions": Leaf, "prompt": "p"} | ok | bad))
    with pytest.raises(ImportError):
        O.checked(Leaf, "p", batch_size=1, checkpoint_path="a.xlsx", **ok)
    model, o = O.checked(None, "p", Leaf, reprocess_columns="a", **ok)
    assert model is Leaf and o.reprocess == ("a",) and o.status_column == "_status" and o.prompt.endswith("{texto}")


def test_text_column():
    for columns, want in [(["decisao", "x"], "decisao"), (["text", "y"], "text"), (["mensagem"], "mensagem")]:
        assert O.resolve_text_column(columns) == want
    with pytest.warns(UserWarning):
        assert O.resolve_text_column(["content", "texto"]) == "texto"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert O.resolve_text_column(["content", "texto"], "content") == "content"
    for bad in ((["id", "payload"], None), (["a"], "b")):
        with pytest.raises(ValueError):
            O.resolve_text_column(*bad)


@pytest.mark.parametrize(
    ("case", "risky"),
    [((100, 4, 20, True, 0, "tavily"), True), ((10, 1, 2, False, 2.0, "tavily"), False), ((50, 1, 5, False, 2.0, "tavily"), True), ((50, 1, 5, False, 2.0, "exa"), False)],
)
def test_rates(case, risky):
    r = O.search_rate(*case)
    assert r.risky is risky
    assert r.concurrent == case[2] * (case[1] if case[3] else 1) and r.delay >= 0.5 and r.parallel_requests >= 1


def test_small_parts():
    assert slices([(0, 3), (100, 1), (200, 4)], 3) == [[(0, 2)], [(100, 100), (200, 201)], [(202, 203)]] and slices([], 2) == []
    assert concurrency(1, 8) == (1, 1) and concurrency(12, 8) == (6, 2) and concurrency(7, 4) == (1, 7)
    assert ordered(["_status", "a", "_trace", "_trace_b", "_search_credits", "_input_tokens", "z", "_error_details"]) == ["a", "_trace", "z", "_trace_b", "_search_credits", "_input_tokens", "_status", "_error_details"]

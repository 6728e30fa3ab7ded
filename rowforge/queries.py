"""The engine's queries over the test tables, and the SQL that gives the same rows.

Answers come from rules (:class:`rowforge.providers.RuleProvider`), so each result is a function of the table.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
import warnings
from typing import Literal

from pydantic import BaseModel, Field
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats
from .errors import error_kind_column, rate_limit_column, recoverable_column
from .functions.conditions import condition_column
from .functions.text import normalize_columns, parse_json_column, prompt_column
from .functions.usage import exa_credits, tavily_credits
from .operators.enrich import enrich, enrich_with_stats
from .operators.executor import execute
from .operators.state import Checkpoint, set_up_columns, shared_dir
from .options import checked, resolve_text_column, search_rate, search_rate_columns
from .plans.planner import compile_plan
from .providers import ReplyProvider, RuleProvider
from .search.corpus import CorpusSearch, find_terms
from .search.web import ExaProvider, TavilyProvider
from .sources.readers import read_table
from .streaming.enrich_stream import enrich_stream

PROMPT = "Classifique o texto.\n\n{texto}\n\nFim."
_NEG, _POS = re.compile(r"\bworthless\b", re.ASCII), re.compile(r"\bthe\b", re.ASCII)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- models and rules --


class Label(BaseModel):
    label: Literal["pos", "neg", "neu"]


class Pair(BaseModel):
    label: str
    size: str


class Chain(BaseModel):
    size: str
    label: str | None = Field(None, json_schema_extra={"condition": {"field": "size", "equals": "long"}})
    words: int | None = Field(None, json_schema_extra={"condition": {"field": "label", "equals": "pos"}})


class Words(BaseModel):
    words: int


class Four(BaseModel):
    a: str
    b: str
    c: str
    d: str


class Item(BaseModel):
    word: str
    length: int | None = Field(None, json_schema_extra={"search_depth": "basic"})


class Items(BaseModel):
    items: list[Item]


class Info(BaseModel):
    length: int | None = Field(None, json_schema_extra={"search_depth": "basic"})


class DeepItem(BaseModel):
    word: str
    info: Info


class DeepItems(BaseModel):
    items: list[DeepItem]


class Two(BaseModel):
    a: str
    b: str


class Props(BaseModel):
    k: int


def _if(op: str, value, field: str = "kind"):
    return Field(None, json_schema_extra={"condition": {"field": field, op: value}})


class Conditions(BaseModel):
    kind: str | None
    props: Props
    eq: bool | None = _if("equals", "click")
    ne: bool | None = _if("not_equals", "click")
    among: bool | None = _if("in", ["click", "view"])
    outside: bool | None = _if("not_in", ["click", None])
    there: bool | None = _if("exists", True)
    deep: bool | None = _if("in", [1, 42, 69], "props.k")


class OfflineTavily(TavilyProvider):
    """The vendor's prices without its package."""

    name, env_var, package_name = "offline_a", None, None

    def create_tool(self, max_results, **options):
        return lambda query: []


class OfflineExa(ExaProvider):
    """The vendor's prices without its package, for more results than are asked for."""

    name, env_var, package_name = "offline_b", None, None

    def create_tool(self, max_results, **options):
        return lambda query: []

    def calculate_credits(self, search_count, max_results=5, **options):
        return super().calculate_credits(search_count, max_results=2 * max_results)


class Inner(BaseModel):
    size: str | None = Field(None, json_schema_extra={"search_depth": "advanced"})


class Outer(BaseModel):
    inner: Inner


def label_of(text: str) -> str:
    low = text.lower()
    return "neg" if _NEG.search(low) else "pos" if _POS.search(low) else "neu"


def size_of(text: str) -> str:
    return "long" if len(text) > 1000 else "short"


def words_of(text: str) -> int:
    return len(_WORD.findall(text))


def first_words(text: str) -> list[dict]:
    return [{"word": w} for w in _WORD.findall(text)[:3]]


def length_of(text: str, known: dict, prompt: str) -> int:
    """Of the word that an item's prompt names."""
    return len(re.search(r"para: word: (.*)\n", prompt)[1])


def context_size(text: str, known: dict, prompt: str) -> dict:
    """What the prompt says of a search made before."""
    return {"size": re.search(r"- inner\.size: (\w+)", prompt)[1]}


def fail_short(text: str) -> None:
    if len(text) < 20:
        raise ValueError("short text")


_tries = threading.local()


def fail_at_first(text: str) -> None:
    """Fails len(text) % 3 times before it lets a row pass; a row's attempts follow each other in one thread."""
    if getattr(_tries, "text", None) != text:
        _tries.text, _tries.n = text, 0
    if _tries.n < len(text) % 3:
        _tries.n += 1
        raise RuntimeError("503 busy")
    _tries.text = None


LABEL = RuleProvider({"label": label_of})
PAIR = RuleProvider({"label": label_of, "size": size_of})
CHAIN = RuleProvider({"size": size_of, "label": label_of, "words": words_of})
SEARCH = {"use_search": True, "search_provider": "corpus", "search_per_field": True}
CALLS = {"parallel_requests": 8}


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", "text")


# -- queries --


def q_prompt_len(spark, d):
    return _docs(spark, d).select("doc_id", F.length(prompt_column(PROMPT, F.col("text"))).cast("long").alias("prompt_len"))


def q_classify_docs(spark, d):
    return enrich(_docs(spark, d), Label, PROMPT, provider=LABEL, **CALLS).select("doc_id", "label")


def q_label_counts(spark, d):
    return q_classify_docs(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))


def q_tokens(spark, d):
    out = enrich(_docs(spark, d), Label, PROMPT, provider=LABEL, **CALLS)
    return out.select("doc_id", F.col("_input_tokens").alias("input_tokens"), F.col("_output_tokens").alias("output_tokens"))


def q_token_totals(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang")
    out = enrich(docs, Label, PROMPT, provider=LABEL, **CALLS)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_input_tokens").alias("input_tokens"), F.sum("_output_tokens").alias("output_tokens"))


def q_word_count(spark, d):
    return enrich(_docs(spark, d), Words, PROMPT, provider=RuleProvider({"words": words_of}), **CALLS).select("doc_id", "words")


def q_cost(spark, d):
    t = q_tokens(spark, d)
    return t.select("doc_id", stats.cost(F.col("input_tokens"), F.col("output_tokens"), 0.075, 0.3).alias("cost"))


def _seeded(spark, d, **columns):
    """Documents of which those with labels count as done before."""
    seen = _read(spark, d, "labels").select("doc_id").distinct().withColumn("_status", F.lit("processed"))
    docs = _docs(spark, d).join(seen, "doc_id", "left")
    return docs.withColumns({c: F.when(F.col("_status").isNotNull(), v) for c, v in columns.items()})


def q_resume_pending(spark, d):
    out = enrich(_seeded(spark, d, label="seed"), Label, PROMPT, provider=LABEL, **CALLS)
    return out.select("doc_id", "label", F.col("_input_tokens").isNotNull().alias("called"))


def q_reprocess(spark, d):
    out = enrich(_seeded(spark, d, label="old", size="old"), Pair, PROMPT, provider=PAIR, reprocess_columns="label", **CALLS)
    return out.select("doc_id", "label", "size")


def q_error_isolation(spark, d):
    out = enrich(_docs(spark, d), Label, PROMPT, provider=RuleProvider({"label": label_of}, fail_short), max_retries=1, keep_status=True, **CALLS)
    return out.select("doc_id", "label", F.col("_status").alias("status"), F.col("_error_details").alias("details"))


def q_status_counts(spark, d):
    return stats.status_counts(q_error_isolation(spark, d), "status")


def q_retry_success(spark, d):
    out = enrich(_docs(spark, d), Label, PROMPT, provider=RuleProvider({"label": label_of}, fail_at_first), base_delay=0.0, **CALLS)
    return out.select("doc_id", "label", F.col("_error_details").alias("details"))


MESSAGES = [
    "RateLimitError: Error 429: Too many requests", "ResourceExhausted: Quota exceeded", "ValueError: Invalid argument", "AuthenticationError: bad key",
    "Timeout: no answer", "ConnectionError: reset", "Exception: 401 unauthorized", "PermissionDenied: model", "Exception: 503 busy",
    "UsageLimitExceededError: tavily limit", "KeyError: 'x'", "NotFound: model 404", "Exception: an example of limits", "Error: exa quota",
]


def q_error_class(spark, d):
    m = F.col("message")
    rows = spark.createDataFrame([(x,) for x in MESSAGES], "message string")
    return rows.select("message", recoverable_column(m).alias("recoverable"), rate_limit_column(m).alias("rate_limited"), error_kind_column(m).alias("kind"))


def q_drop_clean(spark, d):
    clean = enrich(_docs(spark, d), Label, PROMPT, provider=LABEL, **CALLS).columns
    held = enrich(_docs(spark, d), Label, PROMPT, provider=LABEL, status_column="my_status", **CALLS).columns
    return spark.createDataFrame([(k, i, c) for k, cols in (("clean", clean), ("named", held)) for i, c in enumerate(cols)], "run string, place long, name string")


def _condition(op, value):
    def query(spark, d):
        events = _read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind"))
        return events.select("event_id", condition_column({"field": "kind", op: value}, events.schema).alias("holds"))

    return query


def q_condition_nested(spark, d):
    events = _read(spark, d, "events").select("event_id", "props")
    return events.select("event_id", condition_column({"field": "props.k", "in": ["1", "42", "69"]}, events.schema).alias("holds"))


def q_chain(spark, d):
    return enrich(_docs(spark, d), Chain, PROMPT, provider=CHAIN, **SEARCH, **CALLS).select("doc_id", "size", "label", "words")


def q_per_field_usage(spark, d):
    out = enrich(_docs(spark, d), Chain, PROMPT, provider=CHAIN, **SEARCH, **CALLS)
    return out.select("doc_id", F.col("_search_credits").alias("credits"), F.col("_input_tokens").alias("input_tokens"), F.col("_output_tokens").alias("output_tokens"))


def q_group_calls(spark, d):
    rules = RuleProvider(dict.fromkeys("abcd", size_of))
    out = enrich(_docs(spark, d), Four, PROMPT, provider=rules, search_groups={"g": {"fields": ["b", "d"], "prompt": "Procure {query}"}}, **SEARCH, **CALLS)
    return out.select("doc_id", "a", "b", "c", "d", F.col("_search_credits").alias("credits"), F.col("_output_tokens").alias("output_tokens"))


def q_list_enrich(spark, d):
    out = enrich(_docs(spark, d), Items, PROMPT, provider=RuleProvider({"items": first_words, "length": length_of}), **SEARCH, **CALLS)
    return out.select("doc_id", F.posexplode("items").alias("place", "item"), F.col("_search_credits").alias("credits")).select(
        "doc_id", F.col("place").cast("long").alias("place"), F.col("item.word").alias("word"), F.col("item.length").alias("length"), "credits"
    )


def q_nested_search(spark, d):
    out = enrich(_docs(spark, d), Outer, PROMPT, provider=RuleProvider({"inner": context_size, "size": size_of}), save_trace="minimal", **SEARCH, **CALLS)
    traced = F.get_json_object("_trace_inner__size", "$.search_queries[0]")
    return out.select("doc_id", F.col("inner.size").alias("size"), F.col("_search_credits").alias("credits"), traced.alias("query"))


def q_set_nested(spark, d):
    """Searches whose answers are written into a nested field of each list item."""
    rules = RuleProvider({"items": lambda text: [{"word": w, "info": {}} for w in _WORD.findall(text)[:3]], "length": length_of})
    out = enrich(_docs(spark, d), DeepItems, PROMPT, provider=rules, **SEARCH, **CALLS)
    return out.select("doc_id", F.posexplode("items").alias("place", "item")).select("doc_id", F.col("place").cast("long").alias("place"), F.col("item.word").alias("word"), F.col("item.info.length").alias("length"))


def q_engine_prompt(spark, d):
    """The length of the prompt that a call gets."""
    return enrich(_docs(spark, d), Words, PROMPT, provider=RuleProvider({"words": lambda text, known, prompt: len(prompt)}), **CALLS).select("doc_id", F.col("words").alias("prompt_len"))


def q_engine_conditions(spark, d):
    """Every operator of a condition, on a field and in a nested one, as the run of a row decides it."""
    events = _read(spark, d, "events").select("event_id", F.concat_ws("|", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).otherwise(""), F.col("props")).alias("text"))
    rules = {"kind": lambda text: text.split("|")[0] or None, "props": lambda text: json.loads(text.split("|", 1)[1])} | dict.fromkeys(("eq", "ne", "among", "outside", "there", "deep"), True)
    out = enrich(events, Conditions, "x {texto}", provider=RuleProvider(rules), **SEARCH, **CALLS)
    return out.select("event_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("eq", "ne", "among", "outside", "there", "deep")])


def _reply(prompt: str):
    """A reply that holds a count in a fence, in braces among words, in blocks of text, or alone."""
    n = len(prompt)
    held = json.dumps({"words": n})
    blocks = [{"type": "text", "text": held[:5]}, held[5:]]
    return (f"Aqui:\n```json\n{held}\n```\nFim.", f"O resultado: {held} (fim)", blocks, held)[n % 4]


def q_engine_parse_json(spark, d):
    """Replies as text, read as a model's replies are."""
    return enrich(_docs(spark, d), Words, "{texto}", provider=ReplyProvider(_reply), **CALLS).select("doc_id", "words")


def q_engine_credits(spark, d):
    """Credits of two searches a row by the prices of two vendors, of another depth and number of results."""
    docs, rules = _docs(spark, d), RuleProvider(dict.fromkeys("ab", size_of))
    how = {"use_search": True, "search_per_field": True, "provider": rules, **CALLS}
    advanced = enrich(docs, Two, PROMPT, search_provider=OfflineTavily(), search_depth="advanced", **how).select("doc_id", F.col("_search_credits").alias("tavily"))
    many = enrich(docs, Two, PROMPT, search_provider=OfflineExa(), max_results=20, **how).select(F.col("doc_id").alias("d2"), F.col("_search_credits").alias("exa"))
    return advanced.join(many, F.col("doc_id") == F.col("d2")).drop("d2")


def fail_by_length(text: str) -> None:
    raise RuntimeError(MESSAGES[len(text) % len(MESSAGES)])


def q_engine_errors(spark, d):
    """Which errors are tried again, and how they read."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = enrich(_docs(spark, d), Label, PROMPT, provider=RuleProvider({"label": label_of}, fail_by_length), max_retries=2, base_delay=0.0, **CALLS)
    return out.select("doc_id", F.col("_status").alias("status"), F.col("_error_details").alias("details"))


def q_engine_rate_warning(spark, d):
    rows = []
    for i in range(600):
        r = search_rate(100, 1 + i % 5, 1 + i // 5 % 20, i // 100 % 2 == 0, (0.0, 0.5, 2.0)[i // 200 % 3], "tavily" if i % 2 == 0 else "exa")
        rows.append((i, r.concurrent, round(float(r.per_minute), 6), r.risky))
    return spark.createDataFrame(rows, "id long, concurrent long, per_minute double, risky boolean")


LIBRARY = ("The first river", "a worthless THE", "nicht", "the mill and the river", "über den Fluss")


def q_search_found(spark, d):
    """Each document's first word is searched for in a small library; the answer is what was found."""
    first = lambda text, names: (_WORD.findall(text) or [""])[0]
    rules = RuleProvider({"words": lambda text, known, prompt, found: len(found)}, query=first)
    out = enrich(_docs(spark, d), Words, PROMPT, provider=rules, use_search=True, search_provider=CorpusSearch(LIBRARY, "library"), save_trace=True, **CALLS)
    trace = F.from_json("_trace", "messages array<struct<type:string,content:string>>, search_queries array<string>")
    said = F.filter(trace["messages"], lambda m: m["type"] == "tool")[0]["content"]
    return out.select("doc_id", "words", F.get(trace["search_queries"], F.lit(0)).alias("query"), said.alias("found"))


def q_read_json_columns(spark, d):
    """A file whose columns hold JSON, some of it odd, read without a model: nothing is lost."""
    events = _read(spark, d, "events").select("event_id", "props")
    odd = (
        F.when(F.col("event_id") % 11 == 3, F.lit('{"other": [1, "x"]}')).when(F.col("event_id") % 11 == 5, "[bad").when(F.col("event_id") % 11 == 7, "plain words").otherwise(F.col("props"))
    )
    path = f"{shared_dir(spark)}/rowforge/json-{uuid.uuid4().hex}.parquet"
    events.select("event_id", "props", odd.alias("odd")).write.parquet(path)
    t = read_table(path, spark=spark)
    get = lambda what, kind: F.try_variant_get("odd", what, kind)
    return t.select("event_id", F.col("props.k").alias("k"), get("$.k", "bigint").alias("odd_k"), get("$.other[1]", "string").alias("other"), F.when(F.schema_of_variant("odd") == "STRING", get("$", "string")).alias("words"))


def q_parse_json(spark, d):
    events, p = _read(spark, d, "events"), F.col("props")
    reply = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Aqui:\n```json\n"), p, F.lit("\n```\nFim.")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("O resultado: "), p, F.lit(" (fim)")))
        .otherwise(p)
    )
    return events.select("event_id", parse_json_column(reply, "k long")["k"].alias("k"))


def q_normalize(spark, d):
    from pyspark.sql import types as T

    odd = F.when(F.col("event_id") % 4 == 0, "[bad").when(F.col("event_id") % 4 == 1, None).otherwise(F.concat(F.lit("  "), "props"))
    events = _read(spark, d, "events").select("event_id", odd.alias("props"))
    out = normalize_columns(events, {"props": T.StructType([T.StructField("k", T.LongType())])}, keep_raw=True)
    return out.select("event_id", F.col("props.k").alias("k"), F.col("props_raw").alias("raw"))


def q_trace_queries(spark, d):
    out = enrich(_docs(spark, d), Label, PROMPT, provider=LABEL, use_search=True, search_provider="corpus", save_trace="minimal", **CALLS)
    trace = F.from_json("_trace", "messages array<struct<type:string,content:string>>, search_queries array<string>, total_tool_calls long")
    hidden = F.size(F.filter(trace["messages"], lambda m: m["content"] == "[omitted]"))
    return out.select("doc_id", F.size(trace["search_queries"]).cast("long").alias("n_queries"), trace["total_tool_calls"].alias("n_calls"), hidden.cast("long").alias("n_omitted"))


def _grid(spark, d):
    return _read(spark, d, "events").select("event_id", (F.col("event_id") % 7).alias("n"), F.when(F.col("event_id") % 2 == 0, "advanced").otherwise("basic").alias("depth"), (F.col("event_id") % 40).alias("results"))


def q_credits_tavily(spark, d):
    return _grid(spark, d).select("event_id", tavily_credits(F.col("n"), F.col("depth")).alias("credits"))


def q_credits_exa(spark, d):
    return _grid(spark, d).select("event_id", exa_credits(F.col("n"), F.col("results")).alias("credits"))


def q_rate_warning(spark, d):
    g = spark.range(600).select(
        "id", (1 + F.col("id") % 5).alias("fields"), (1 + F.floor(F.col("id") / 5) % 20).alias("parallel"), (F.floor(F.col("id") / 100) % 2 == 0).alias("per_field"),
        F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)), (1 + F.floor(F.col("id") / 200) % 3).cast("int")).alias("delay"), F.when(F.col("id") % 2 == 0, "tavily").otherwise("exa").alias("provider"),
    )
    c = search_rate_columns(*[F.col(x) for x in ("fields", "parallel", "per_field", "delay", "provider")])
    return g.select("id", c["concurrent"].cast("long").alias("concurrent"), F.round(c["per_minute"], 6).alias("per_minute"), c["risky"].alias("risky"))


def q_column_infer(spark, d):
    cases = [["id", "texto"], ["text", "id"], ["decisao", "x"], ["content_text", "x"], ["mensagem"]]
    return spark.createDataFrame([(i, resolve_text_column(c)) for i, c in enumerate(cases)], "id long, name string")


TERMS = ["the", "worthless", "tracking", "Nicht", "%"]


def q_search_corpus(spark, d):
    return find_terms(TERMS, _read(spark, d, "pages"), "html").select("term", "page_id")


def q_label_agreement(spark, d):
    out = q_classify_docs(spark, d).join(_read(spark, d, "labels"), "doc_id")
    return out.groupBy("label", "quality").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("toxic").cast("long").alias("n_toxic"))


def q_dedup_calls(spark, d):
    return enrich(_docs(spark, d), Label, PROMPT, provider=LABEL, dedup_calls=True, **CALLS).select("doc_id", "label")


def q_dedup_stats(spark, d):
    s = enrich_with_stats(_docs(spark, d), Label, PROMPT, provider=LABEL, dedup_calls=True, **CALLS)[1]
    return spark.createDataFrame([(s.calls, s.errors, s.retries)], "calls long, errors long, retries long")


def q_checkpoint_resume(spark, d):
    """A run that was cut off after the documents of even number, and the run that goes on."""
    path = f"{shared_dir(spark)}/rowforge/run-{uuid.uuid4().hex}.parquet"
    docs = _docs(spark, d)
    model, o = checked(Label, PROMPT, provider=LABEL, batch_size=500, checkpoint_path=path, key="doc_id", **CALLS)
    plan = compile_plan(model, o)
    from .functions.schema import struct_of

    ready = set_up_columns(docs, plan, o, struct_of(model))
    Checkpoint(spark, path, "doc_id").save(execute(ready.where("doc_id % 2 = 0"), "text", plan, o))
    enrich(docs, Label, PROMPT, provider=LABEL, batch_size=500, checkpoint_path=path, key="doc_id", **CALLS)
    return spark.read.parquet(path).select("doc_id", "label", F.col("_status").alias("status"))


def q_stream_classify(spark, d):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(_read(spark, d, "documents").schema)
    stream = reader.parquet(f"{d}/documents.parquet") if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    root = f"{shared_dir(spark)}/rowforge/stream-{uuid.uuid4().hex}"
    out = enrich_stream(stream.select("doc_id", "text"), Label, PROMPT, provider=LABEL, **CALLS)
    out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("doc_id", "label", F.col("_status").alias("status"))


def q_roundtrip_containers(spark, d):
    texts = ["the one", "worthless", "nada"]
    rows = [("list", str(i), x) for i, x in enrich(texts, Label, PROMPT, provider=LABEL, spark=spark)["label"].items()]
    rows += [("dict", str(i), x) for i, x in enrich(dict(zip("xyz", texts, strict=True)), Label, PROMPT, provider=LABEL, spark=spark)["label"].items()]
    return spark.createDataFrame(rows, "kind string, key string, label string")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")} | {
    "q_condition_equals": _condition("equals", "click"),
    "q_condition_not_equals": _condition("not_equals", "click"),
    "q_condition_in": _condition("in", ["click", "view"]),
    "q_condition_not_in": _condition("not_in", ["click", None]),
    "q_condition_exists": _condition("exists", True),
}

# -- the same in SQL --

_LABEL = r"CASE WHEN regexp_matches(lower(text), '\bworthless\b') THEN 'neg' WHEN regexp_matches(lower(text), '\bthe\b') THEN 'pos' ELSE 'neu' END"
_SIZE = "CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END"
_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
_ASKED = "CAST((length(text) + 3) // 4 AS BIGINT)"
_KIND = "CASE WHEN event_id % 7 <> 0 THEN event_type END"
_PLACE = "event_id % 7 AS n, CASE WHEN event_id % 2 = 0 THEN 'advanced' ELSE 'basic' END AS depth, event_id % 40 AS results"
_CHAIN = f"SELECT *, {_SIZE} AS size, CASE WHEN {_SIZE} = 'long' THEN {_LABEL} END AS label FROM documents"


def _values(rows: list[str]) -> str:
    return ", ".join("('" + r.replace("'", "''") + "')" for r in rows)


def _holds(expression: str) -> str:
    return f"SELECT event_id, {expression} AS holds FROM (SELECT event_id, {_KIND} AS kind FROM events)"


ORACLE = {
    "q_prompt_len": "SELECT doc_id, length(replace('Classifique o texto.' || chr(10) || chr(10) || '{texto}' || chr(10) || chr(10) || 'Fim.', '{texto}', text)) AS prompt_len FROM documents",
    "q_classify_docs": f"SELECT doc_id, {_LABEL} AS label FROM documents",
    "q_label_counts": f"SELECT {_LABEL} AS label, count(*) AS n_docs FROM documents GROUP BY 1",
    "q_tokens": f"SELECT doc_id, {_ASKED} AS input_tokens, CAST(1 AS BIGINT) AS output_tokens FROM documents",
    "q_token_totals": f"SELECT lang, count(*) AS n_docs, CAST(sum({_ASKED}) AS BIGINT) AS input_tokens, count(*) AS output_tokens FROM documents GROUP BY lang",
    "q_word_count": f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS words FROM documents",
    "q_cost": f"SELECT doc_id, round(({_ASKED} * 0.075::DOUBLE + 1 * 0.3::DOUBLE) / 1e6::DOUBLE, 6) AS cost FROM documents",
    "q_resume_pending": f"SELECT doc_id, CASE WHEN seen THEN 'seed' ELSE {_LABEL} END AS label, NOT seen AS called FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS seen FROM documents)",
    "q_reprocess": f"SELECT doc_id, {_LABEL} AS label, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'old' ELSE {_SIZE} END AS size FROM documents",
    "q_error_isolation": f"SELECT doc_id, CASE WHEN length(text) >= 20 THEN {_LABEL} END AS label, CASE WHEN length(text) < 20 THEN 'error' ELSE 'processed' END AS status, CASE WHEN length(text) < 20 THEN '[Falhou após 1 tentativa(s)] ValueError: short text' END AS details FROM documents",
    "q_status_counts": "SELECT CASE WHEN length(text) < 20 THEN 'error' ELSE 'processed' END AS status, count(*) AS n_rows FROM documents GROUP BY 1",
    "q_retry_success": f"SELECT doc_id, {_LABEL} AS label, CASE WHEN length(text) % 3 > 0 THEN 'Sucesso após ' || length(text) % 3 || ' retry(s)' END AS details FROM documents",
    "q_error_class": f"""
        SELECT message,
               NOT regexp_matches(lower(message), 'authenticationerror|invalidapikey|permissiondenied|invalidargument|notfound|401|403|404|missingapikeyerror|badrequesterror') AS recoverable,
               regexp_matches(lower(message), 'ratelimit|resourceexhausted|toomanyrequests|429') AS rate_limited,
               CASE WHEN regexp_matches(lower(message), 'authenticationerror|invalidapikey|401|api_key|api key') THEN 'authentication'
                    WHEN regexp_matches(lower(message), 'permissiondenied|403|forbidden') THEN 'permission'
                    WHEN regexp_matches(lower(message), 'ratelimit|resourceexhausted|toomanyrequests|429') THEN 'rate_limit'
                    WHEN regexp_matches(lower(message), 'timeout|deadlineexceeded|504') THEN 'timeout'
                    WHEN regexp_matches(lower(message), 'connectionerror|connectionreset|sslerror|network') THEN 'connection'
                    WHEN regexp_matches(lower(message), 'tavily|\\bexa\\b') AND regexp_matches(lower(message), 'apikey|api_key|missing|invalid|unauthorized') THEN 'search_key'
                    WHEN regexp_matches(lower(message), 'usagelimitexceeded') OR regexp_matches(lower(message), 'tavily|\\bexa\\b') AND regexp_matches(lower(message), 'limit|quota|exceeded') THEN 'search_quota'
                    ELSE 'other' END AS kind
        FROM (VALUES {_values(MESSAGES)}) t(message)
    """,
    "q_drop_clean": """
        SELECT run, CAST(place AS BIGINT) AS place, name FROM (VALUES
            ('clean', 0, 'doc_id'), ('clean', 1, 'text'), ('clean', 2, 'label'), ('clean', 3, '_input_tokens'), ('clean', 4, '_output_tokens'), ('clean', 5, '_reasoning_tokens'),
            ('named', 0, 'doc_id'), ('named', 1, 'text'), ('named', 2, 'label'), ('named', 3, 'my_status'), ('named', 4, '_input_tokens'), ('named', 5, '_output_tokens'),
            ('named', 6, '_reasoning_tokens'), ('named', 7, '_error_details')) t(run, place, name)
    """,
    "q_condition_equals": _holds("kind IS NOT DISTINCT FROM 'click'"),
    "q_condition_not_equals": _holds("kind IS DISTINCT FROM 'click'"),
    "q_condition_in": _holds("coalesce(kind IN ('click', 'view'), false)"),
    "q_condition_not_in": _holds("kind IS NOT NULL AND kind <> 'click'"),
    "q_condition_exists": _holds("kind IS NOT NULL"),
    "q_condition_nested": "SELECT event_id, coalesce(props->>'$.k' IN ('1', '42', '69'), false) AS holds FROM events",
    "q_chain": f"SELECT doc_id, size, label, CASE WHEN label = 'pos' THEN CAST({_WORDS} AS BIGINT) END AS words FROM ({_CHAIN})",
    "q_per_field_usage": f"SELECT doc_id, n AS credits, n * {_ASKED} AS input_tokens, n AS output_tokens FROM (SELECT *, CAST(1 + (size = 'long')::INT + coalesce(label = 'pos', false)::INT AS BIGINT) AS n FROM ({_CHAIN}))",
    "q_group_calls": f"SELECT doc_id, {_SIZE} AS a, {_SIZE} AS b, {_SIZE} AS c, {_SIZE} AS d, CAST(3 AS BIGINT) AS credits, CAST(4 AS BIGINT) AS output_tokens FROM documents",
    "q_list_enrich": r"""
        SELECT doc_id, CAST(place - 1 AS BIGINT) AS place, w[place] AS word, length(w[place]) AS length, CAST(1 + len(w) AS BIGINT) AS credits
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:3] AS w FROM documents) x, unnest(range(1, len(w) + 1)) u(place)
    """,
    "q_nested_search": f"SELECT doc_id, {_SIZE} AS size, CAST(2 AS BIGINT) AS credits, 'size' AS query FROM documents",
    "q_set_nested": r"""
        SELECT doc_id, CAST(place - 1 AS BIGINT) AS place, w[place] AS word, length(w[place]) AS length
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:3] AS w FROM documents) x, unnest(range(1, len(w) + 1)) u(place)
    """,
    "q_engine_prompt": "SELECT doc_id, length('Classifique o texto.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Fim.') AS prompt_len FROM documents",
    "q_engine_conditions": f"""
        SELECT event_id, kind IS NOT DISTINCT FROM 'click' AS eq, kind IS DISTINCT FROM 'click' AS ne, coalesce(kind IN ('click', 'view'), false) AS among,
               kind IS NOT NULL AND kind <> 'click' AS outside, kind IS NOT NULL AS there, coalesce(CAST(props->>'$.k' AS BIGINT) IN (1, 42, 69), false) AS deep
        FROM (SELECT event_id, {_KIND} AS kind, props FROM events)
    """,
    "q_engine_parse_json": "SELECT doc_id, length(text) AS words FROM documents",
    "q_engine_credits": "SELECT doc_id, CAST(4 AS BIGINT) AS tavily, CAST(10 AS BIGINT) AS exa FROM documents",
    "q_engine_errors": f"""
        WITH t AS (SELECT doc_id, [{", ".join("'" + m.replace("'", "''") + "'" for m in MESSAGES)}][1 + length(text) % {len(MESSAGES)}] AS message FROM documents)
        SELECT doc_id, 'error' AS status,
               CASE WHEN regexp_matches(lower(message), 'authenticationerror|invalidapikey|permissiondenied|invalidargument|notfound|401|403|404|missingapikeyerror|badrequesterror')
                    THEN '[Erro não-recuperável] ' ELSE '[Falhou após 2 tentativa(s)] ' END || 'RuntimeError: ' || message AS details FROM t
    """,
    "q_engine_rate_warning": """
        SELECT id, CAST(parallel * each AS BIGINT) AS concurrent, round(rate, 6) AS per_minute,
               parallel * each > 10 OR rate > 0.8 * CASE WHEN id % 2 = 0 THEN 100 ELSE 300 END AS risky
        FROM (SELECT *, CASE WHEN delay > 0 THEN 60 / delay ELSE 60 END * parallel * each AS rate
              FROM (SELECT range AS id, CASE WHEN (range // 100) % 2 = 0 THEN 1 + range % 5 ELSE 1 END AS each, 1 + (range // 5) % 20 AS parallel,
                           [0.0, 0.5, 2.0][1 + (range // 200) % 3]::DOUBLE AS delay FROM range(600)))
    """,
    "q_search_found": rf"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1], '') AS query FROM documents)
        SELECT doc_id, len(hits) AS words, query, array_to_string(hits, chr(10)) AS found
        FROM (SELECT doc_id, query, list_filter([{", ".join("'" + x + "'" for x in LIBRARY)}], lambda x: contains(lower(x), lower(query))) AS hits FROM w)
    """,
    "q_read_json_columns": """
        SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CASE WHEN event_id % 11 NOT IN (3, 5, 7) THEN CAST(props->>'$.k' AS BIGINT) END AS odd_k,
               CASE WHEN event_id % 11 = 3 THEN 'x' END AS other, CASE event_id % 11 WHEN 5 THEN '[bad' WHEN 7 THEN 'plain words' END AS words
        FROM events
    """,
    "q_parse_json": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "q_normalize": "SELECT event_id, CASE WHEN event_id % 4 > 1 THEN CAST(props->>'$.k' AS BIGINT) END AS k, CASE WHEN event_id % 4 = 0 THEN '[bad' END AS raw FROM events",
    "q_trace_queries": "SELECT doc_id, CAST(1 AS BIGINT) AS n_queries, CAST(1 AS BIGINT) AS n_calls, CAST(1 AS BIGINT) AS n_omitted FROM documents",
    "q_credits_tavily": f"SELECT event_id, n * CASE WHEN depth = 'advanced' THEN 2 ELSE 1 END AS credits FROM (SELECT event_id, {_PLACE} FROM events)",
    "q_credits_exa": f"SELECT event_id, n * CASE WHEN results <= 25 THEN 1 ELSE 5 END AS credits FROM (SELECT event_id, {_PLACE} FROM events)",
    "q_rate_warning": """
        SELECT id, CAST(parallel * each AS BIGINT) AS concurrent, round(rate, 6) AS per_minute,
               parallel * each > 10 OR rate > 0.8 * CASE WHEN id % 2 = 0 THEN 100 ELSE 300 END AS risky
        FROM (SELECT *, CASE WHEN delay > 0 THEN 60 / delay ELSE 60 END * parallel * each AS rate
              FROM (SELECT range AS id, CASE WHEN (range // 100) % 2 = 0 THEN 1 + range % 5 ELSE 1 END AS each, 1 + (range // 5) % 20 AS parallel,
                           [0.0, 0.5, 2.0][1 + (range // 200) % 3]::DOUBLE AS delay FROM range(600)))
    """,
    "q_column_infer": "SELECT CAST(id AS BIGINT) AS id, name FROM (VALUES (0, 'texto'), (1, 'text'), (2, 'decisao'), (3, 'content_text'), (4, 'mensagem')) t(id, name)",
    "q_search_corpus": f"SELECT term, page_id FROM (VALUES {_values(TERMS)}) t(term) JOIN pages ON contains(lower(html), lower(term))",
    "q_label_agreement": f"SELECT {_LABEL} AS label, quality, count(*) AS n_docs, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "q_dedup_calls": f"SELECT doc_id, {_LABEL} AS label FROM documents",
    "q_dedup_stats": "SELECT count(DISTINCT text) AS calls, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS retries FROM documents",
    "q_checkpoint_resume": f"SELECT doc_id, {_LABEL} AS label, 'processed' AS status FROM documents",
    "q_stream_classify": f"SELECT doc_id, {_LABEL} AS label, 'processed' AS status FROM documents",
    "q_roundtrip_containers": "SELECT * FROM (VALUES ('list', '0', 'pos'), ('list', '1', 'neg'), ('list', '2', 'neu'), ('dict', 'x', 'pos'), ('dict', 'y', 'neg'), ('dict', 'z', 'neu')) t(kind, key, label)",
}

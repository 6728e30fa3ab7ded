"""The operator that makes the calls: rows in, one result struct a row out, over Arrow batches.

A task opens its client once and runs its rows on a few threads. Errors never leave a row; a task that fails would
repeat its calls, so where all cores are used a task has ``TASK_ROWS`` rows or so. Limits are a task's share of the whole:
with p tasks at once of t threads, p * t calls run at once. With fewer requests than cores, there are as many tasks as requests.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pyarrow as pa
from pydantic import BaseModel, create_model
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import Outcome, attempt, is_rate_limit
from ..functions.conditions import skipped
from ..functions.schema import cell, struct_of
from ..functions.text import build_prompt
from ..functions.usage import COST, COUNTS, add_usage, agent_usage, no_usage, trace_json, trace_of, usage_of
from ..options import Options
from ..plans.planner import CONTEXT, CallPlan, Step, item_context, set_nested, trace_column
from ..providers import find_provider

#: Rows of a task, and so calls that are repeated when it is lost, where there are more tasks than run at once.
TASK_ROWS = 2_000
#: Name of the result struct that rows get.
RESULT = "_result"


def result_type(plan: CallPlan) -> T.StructType:
    """data, status, error, retries, tokens and credits, calls, workers, and a JSON string for each trace."""
    counts = [T.StructField(c, T.LongType()) for c in (*COUNTS, "retries", "calls", "workers")]
    traces = [T.StructField(c, T.StringType()) for c in plan.traces]
    return T.StructType([T.StructField("data", struct_of(plan.model)), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *counts, T.StructField(COST, T.DoubleType()), *traces])


class Throttle:
    """Threads that may call at once: halved when a rate limit was hit for good, never raised again; a pause follows."""

    def __init__(self, workers: int, delay: float, pause: float = 2.0):
        self.workers, self.delay, self.pause = workers, delay, pause
        self.free, self.running, self.until = threading.Condition(), 0, 0.0

    def __enter__(self):
        with self.free:
            self.free.wait_for(lambda: self.running < self.workers)
            self.running += 1
        if (wait := self.until - time.monotonic()) > 0:
            time.sleep(wait)

    def __exit__(self, *_):
        with self.free:
            self.running -= 1
            self.free.notify_all()

    def hit(self) -> None:
        with self.free:
            if self.workers > 1:
                self.workers = max(1, self.workers // 2)
                self.until = time.monotonic() + self.pause


class Run:
    """The calls of one row."""

    def __init__(self, plan: CallPlan, options: Options, client, submodels: dict):
        self.plan, self.options, self.client, self.submodels = plan, options, client, submodels
        self.data: dict = {}
        self.usage, self.traces, self.retries, self.calls = no_usage(), {}, 0, 0

    def submodel(self, step: Step) -> type[BaseModel]:
        key = (step.owner, step.fields)
        if key not in self.submodels:
            if step.fields == tuple(step.owner.model_fields):
                self.submodels[key] = step.owner
            else:
                infos = {n: (step.owner.model_fields[n].annotation, step.owner.model_fields[n]) for n in step.fields}
                self.submodels[key] = create_model("_".join([step.owner.__name__, *step.fields]), **infos)
        return self.submodels[key]

    def call(self, step: Step, prompt: str, text: str) -> tuple[dict, object]:
        """One call with its retries: the answer's values and its trace. Raises ``Failed``."""
        o, model = self.options, self.submodel(step)

        def once():
            self.calls += 1
            began = time.monotonic()
            if step.search is None:
                answer, usage, trace = self.client.ask(prompt, model, text, dict(self.data)), None, None
                usage = usage_of(answer.usage) if answer.usage and "output_token_details" in answer.usage else answer.usage
            else:
                source = step.search.source
                answer = self.client.search(prompt, model, step.search, text, dict(self.data))
                usage = agent_usage(answer.messages, source, step.search.depth, step.search.max_results)
                trace = trace_of(answer.messages, o.model, time.monotonic() - began, o.trace, source) if o.trace else None
            if answer.data is None:
                raise ValueError("no structured answer")
            valid = answer.data if isinstance(answer.data, BaseModel) else model.model_validate(answer.data)
            return valid.model_dump(), usage, trace

        out = attempt(once, o.max_retries, o.base_delay, o.max_delay)
        self.retries += out.retries
        if out.error is not None:
            raise Failed(out)
        data, usage, trace = out.value
        add_usage(self.usage, usage)
        return data, trace

    def __call__(self, text: str) -> None:
        for step in self.plan.steps:
            if skipped(step.condition, self.data):
                self.data |= dict.fromkeys(step.fields)
                continue
            prompt = build_prompt(step.prompt, text)
            context = []
            for inner in step.nested:
                got, trace = self.call(inner, build_prompt(inner.prompt, text), text)
                context.append(f"- {inner.path}: {got.get(inner.fields[0])}")
                self.traces[trace_column(inner.trace)] = trace
            if context:
                prompt += CONTEXT + "\n".join(context)
            got, trace = self.call(step, prompt, text)
            if step.items and isinstance(items := got.get(step.fields[0]), list):
                self.items(step, items, text)
            self.data |= {n: got.get(n) for n in step.fields}
            self.traces["_trace" if step.kind == "single" else trace_column(step.trace)] = trace

    def items(self, step: Step, items: list, text: str) -> None:
        """One call for each item and searched field; the answers are written into the items."""
        from ..functions.schema import list_item_model

        owner, traces = list_item_model(step.owner.model_fields[step.fields[0]].annotation), []
        for item in items:
            if not isinstance(item, dict):
                continue
            about, own = item_context(item, owner), {}
            for inner in step.items:
                got, trace = self.call(inner, build_prompt(inner.prompt.replace("{item}", about), text), text)
                set_nested(item, inner.path, got.get(inner.fields[0]))
                if trace:
                    own[inner.path] = trace
            if own:
                traces.append(own)
        self.traces[trace_column(f"{step.trace}_items")] = traces


class Failed(Exception):
    def __init__(self, outcome: Outcome):
        super().__init__(str(outcome.error))
        self.outcome = outcome


def row_result(plan: CallPlan, options: Options, client, submodels: dict, throttle: Throttle, text: str | None, kind: T.StructType, arrow: pa.DataType) -> dict:
    """The result struct of one row; every ``Exception`` ends in its error. ``arrow``: the type of its data."""
    run, error = Run(plan, options, client, submodels), None
    with throttle:
        try:
            if text is None and options.null_text == "error":
                error = "null text"
            else:
                run(str(text))
        except Failed as e:
            out = replace(e.outcome)
            if is_rate_limit(out.error):
                throttle.hit()
            error = out.details()
        except Exception as e:  # noqa: BLE001
            error = Outcome(None, e).details()
        if error is None and throttle.delay:
            time.sleep(throttle.delay)
    ok = error is None
    details = Outcome(None, None, run.retries).details() if ok else error
    data = None
    if ok:
        try:
            data = cell(run.data, kind["data"].dataType)
            pa.scalar(data, arrow)
        except Exception as e:  # noqa: BLE001
            ok, data, details = False, None, Outcome(None, e).details()
    counts = {COST: None} | (run.usage if ok else no_usage())
    traces = {c: trace_json(run.traces.get(c)) for c in plan.traces} if ok else dict.fromkeys(plan.traces)
    return {"data": data, "status": "processed" if ok else "error", "error": details, **counts, "retries": run.retries, "calls": run.calls, "workers": throttle.workers, **traces}


def concurrency(parallel: int, cores: int) -> tuple[int, int]:
    """Tasks and threads in each, whose product is ``parallel``: as many tasks as there are cores and it divides."""
    tasks = next(p for p in range(min(parallel, max(1, cores)), 0, -1) if parallel % p == 0)
    return tasks, parallel // tasks


def execute(df: DataFrame, text: str, plan: CallPlan, options: Options) -> DataFrame:
    """``df`` with the result struct of each row. Each evaluation makes the calls again: write the result once."""
    kind = result_type(plan)
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks, threads = concurrency(options.parallel_requests, cores)
    if tasks == cores and not df.isStreaming:  # no more than these run at once, however many there are
        tasks *= max(1, -(-df.count() // (tasks * TASK_ROWS)))
    spread = df.coalesce(1) if tasks == 1 else df.repartition(tasks)
    at, provider = df.columns.index(text), find_provider(options.provider)
    arrow, values, delay = to_arrow_type(kind), to_arrow_type(kind["data"].dataType), options.rate_limit_delay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, submodels, throttle = None, {}, Throttle(threads, delay)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                client = client or provider.open(options)
                texts = batch.column(at).to_pylist()
                results = list(pool.map(lambda t: row_result(plan, options, client, submodels, throttle, t, kind, values), texts))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, arrow)], schema=pa.schema([*list(batch.schema), pa.field(RESULT, arrow)]))

    return spread.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(RESULT, kind)]))

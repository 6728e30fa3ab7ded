"""The verb: a table with a text column, a model and a prompt; a column for each field of the model comes out."""

from __future__ import annotations

import time
import warnings
from functools import reduce

from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import friendly_message
from ..functions.schema import complex_fields, struct_of
from ..functions.text import keep_unparsed
from ..options import Options, checked, resolve_text_column, warn_search_rate
from ..plans.planner import CallPlan, compile_plan
from ..providers import find_provider
from ..sources.containers import KEY, TEXT, from_spark, to_spark
from ..stats import RunStats, run_stats
from . import state
from .executor import RESULT, concurrency, execute


def enrich(data, questions: type[BaseModel] | None = None, prompt: str | None = None, perguntas=None, *, spark: SparkSession | None = None, **options):
    """``data`` with a column for each field of the model ``questions``. See ``enrich_with_stats``."""
    return enrich_with_stats(data, questions, prompt, perguntas, spark=spark, **options)[0]


def enrich_with_stats(data, questions=None, prompt=None, perguntas=None, *, spark: SparkSession | None = None, **options) -> tuple[object, RunStats | None]:
    """The enriched table and what it took (None if nothing was called).

    ``data`` is a Spark DataFrame or a local container, which comes back as what it was. Rows with a status are left
    alone unless they are reprocessed (``retry_errors`` adds those in error); each other row gets its calls, once:
    results are written before anything reads them. A row in error keeps its values and says why. Status and error
    columns are dropped if no row has anything to say. Options: ``rowforge.options.checked``.
    """
    model, o = checked(questions, prompt, perguntas, **options)
    find_provider(o.provider).check(o)
    df, origin = to_spark(data, spark)
    text = TEXT if TEXT in df.columns and origin.kind not in ("spark", "pandas", "polars") else resolve_text_column([c for c in df.columns if c != KEY], o.text_column)
    fields, kinds = list(model.model_fields), struct_of(model)
    if o.search:
        warn_search_rate(df.count(), len(fields), o)
    have = [c for c in fields if c in df.columns]
    if have and not o.resume and not o.reprocess:
        warnings.warn(f"columns {have} exist; pass resume=True to go on, or rename them", UserWarning, stacklevel=3)
        return from_spark(df, origin), None
    plan = compile_plan(model, o)
    if o.resume or o.reprocess:
        df = keep_unparsed(df, {n: kinds[n].dataType for n in complex_fields(model)})
    df = state.set_up_columns(df, plan, o, kinds)
    todo = state.pending(o) if o.resume or o.reprocess else F.lit(True)
    began = time.monotonic()
    key = o.key or (KEY if KEY in df.columns else None)
    if o.checkpoint_path:
        results = made = _by_batch(df.where(todo), text, plan, o, key)
    elif o.dedup_calls:
        results, made = _once_for_each_text(df.where(todo), text, plan, o)
    else:
        results = made = state.write_once(execute(df.where(todo), text, plan, o), "results")
    columns = df.columns
    _, threads = concurrency(o.parallel_requests, df.sparkSession.sparkContext.defaultParallelism)
    stats = run_stats(made, time.monotonic() - began, o.parallel_requests, threads)
    if stats.errors:
        name = o.provider if isinstance(o.provider, str) else None
        warnings.warn(f"{stats.errors} of {stats.rows} rows are in error, one of them:\n{friendly_message(stats.error, name)}", UserWarning, stacklevel=3)
    if stats.reduced:
        warnings.warn(stats.notice(), UserWarning, stacklevel=3)
    out = state.merge(results, plan, o, columns).unionByName(df.where(~todo))
    if o.checkpoint_path:
        out = state.write_once(out, "enriched")
        state.save_table(out, o.checkpoint_path)
        state.Checkpoint(df.sparkSession, o.checkpoint_path, key).clear()
    out = state.drop_clean(out, o)
    return from_spark(out.select(*[F.col(f"`{c}`") for c in state.ordered(out.columns)]), origin), stats


def _once_for_each_text(df: DataFrame, text: str, plan: CallPlan, o: Options) -> tuple[DataFrame, DataFrame]:
    """One call for each different text; rows with equal texts share its result. Second: the calls' results alone."""
    held = state.write_once(execute(df.select(F.col(f"`{text}`").alias("_t")).distinct(), "_t", plan, o), "results")
    return df.join(held, F.col(f"`{text}`").eqNullSafe(F.col("_t")), "left").drop("_t"), held


def numbered(df: DataFrame, key: str, name: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df``, written in the order of ``key``, with numbers under ``name`` that ascend with it; the numbers' ranges.

    A range is the first number of a partition and how many rows it has. No task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn(name, F.monotonically_increasing_id())
    held = state.write_once(held, "numbered")
    sizes = held.groupBy(F.shiftright(name, 33).alias("p")).count().orderBy("p").collect()  # a row for each partition
    return held, [(r["p"] << 33, r["count"]) for r in sizes]


def slices(ranges: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Consecutive slices of ``size`` rows (the last may have fewer), each as ranges (first, last) of numbers."""
    out, room = [], 0
    for first, n in ranges:
        at = 0
        while at < n:
            if not room:
                out.append([])
                room = size
            take = min(room, n - at)
            out[-1].append((first + at, first + at + take - 1))
            at, room = at + take, room - take
    return out


def _by_batch(df: DataFrame, text: str, plan: CallPlan, o: Options, key: str | None) -> DataFrame:
    """Batches of ``batch_size`` rows in the order of the key, each written when it is done.

    Rows whose results are in batches of a run that was cut off are not called for again.
    """
    if key is None:
        raise ValueError("a checkpoint needs key=, a column that tells rows apart")
    point = state.Checkpoint(df.sparkSession, o.checkpoint_path, key)
    kind = execute(df, text, plan, o).schema
    before = point.done(kind)
    if before is not None:
        before = before.where(F.col(RESULT)["status"] == "processed")
        df = df.join(before.select(key), key, "left_anti")
    held, ranges = numbered(df, key, "_place")
    for part in slices(ranges, o.batch_size):
        # ranges of a sorted column: the scan skips all other row groups
        here = reduce(lambda a, b: a | b, [F.col("_place").between(lo, hi) for lo, hi in part])
        point.save(execute(held.where(here).drop("_place"), text, plan, o))
    done = point.done(kind)
    if done is None:
        return execute(df.limit(0), text, plan, o)
    # a row in error in an old batch may be processed in a new one
    good = done.where(F.col(RESULT)["status"] == "processed").dropDuplicates([key])
    bad = done.where(F.col(RESULT)["status"] != "processed").dropDuplicates([key]).join(good.select(key), key, "left_anti")
    return good.unionByName(bad.select(*good.columns))

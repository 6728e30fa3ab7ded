"""Enrichment of a stream: the same calls, in micro-batches; what is done is known to the stream's checkpoint."""

from __future__ import annotations

from pydantic import BaseModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import struct_of
from ..operators import state
from ..operators.executor import execute
from ..options import checked, resolve_text_column
from ..plans.planner import compile_plan
from ..providers import find_provider


def enrich_stream(stream: DataFrame, questions: type[BaseModel], prompt: str, **options) -> DataFrame:
    """A streaming table with a column for each field, and status and error columns (a stream has no end to drop them at).

    Write it with a ``checkpointLocation``: each input row is then called for once, but for a micro-batch that was cut off.
    """
    model, o = checked(questions, prompt, **options)
    find_provider(o.provider).check(o)
    text = resolve_text_column(stream.columns, o.text_column)
    plan = compile_plan(model, o)
    df = state.set_up_columns(stream, plan, o, struct_of(model))
    columns = df.columns
    out = state.merge(execute(df, text, plan, o), plan, o, columns)
    return out.select(*[F.col(f"`{c}`") for c in state.ordered(columns)])

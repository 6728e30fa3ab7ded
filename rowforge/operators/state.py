"""What is done, what is to do, and how results meet the rows: resume, reprocessing, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_columns
from ..options import Options
from ..plans.planner import CallPlan
from .executor import RESULT

ERROR = "_error_details"
TOKENS = {"_input_tokens": "input_tokens", "_output_tokens": "output_tokens", "_reasoning_tokens": "reasoning_tokens"}
CREDITS = "_search_credits"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rowforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: whoever reads them makes no call again."""
    path = f"{shared_dir(df.sparkSession)}/rowforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_up_columns(df: DataFrame, plan: CallPlan, options: Options, kinds: T.StructType) -> DataFrame:
    """Missing columns as typed nulls: fields, traces, credits, tokens, status, error."""
    wanted = [(f.name, f.dataType) for f in kinds.fields] + [(t, T.StringType()) for t in plan.traces]
    wanted += [(CREDITS, T.LongType())] if options.search else []
    wanted += [(t, T.LongType()) for t in TOKENS] if options.track_tokens else []
    wanted += [(options.status_column, T.StringType()), (ERROR, T.StringType())]
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(k).alias(n) for n, k in wanted if n not in have])


def pending(options: Options) -> Column:
    """Rows to call for: all when reprocessing; else those without a status, and those in error if that is asked for."""
    if options.reprocess:
        return F.lit(True)
    status = F.col(f"`{options.status_column}`")
    return status.isNull() | ((status == "error") & F.lit(options.retry_errors)) | ~status.isin("processed", "error")


def merge(rows: DataFrame, plan: CallPlan, options: Options, columns: list[str]) -> DataFrame:
    """Results into columns. A row in error keeps its values; of a row that was done, only reprocessed fields change."""
    r, status = F.col(RESULT), F.col(f"`{options.status_column}`")
    good = r["status"] == "processed"
    done = status.eqNullSafe("processed")
    out: dict[str, Column] = {}
    for name in plan.model.model_fields:
        takes = good if not options.reprocess or name in options.reprocess else good & ~done
        out[name] = F.when(takes, r["data"][name]).otherwise(F.col(f"`{name}`"))
    for name in plan.traces:
        out[name] = F.when(good, r[name]).otherwise(F.col(f"`{name}`"))
    if options.search:
        out[CREDITS] = F.when(good, r["search_credits"]).otherwise(F.col(CREDITS))
    if options.track_tokens:
        out |= {c: F.when(good, r[k]).otherwise(F.col(c)) for c, k in TOKENS.items()}
    out[options.status_column], out[ERROR] = r["status"], r["error"]
    return rows.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def drop_clean(df: DataFrame, options: Options) -> DataFrame:
    """Without status and error columns if no row is in error or has details, unless ``keep_status`` is set. A status
    column of another name stays."""
    if options.keep_status or options.status_column != "_status" or ERROR not in df.columns:
        return df
    bad = df.agg(F.bool_or((F.col("_status") == "error") | F.col(ERROR).isNotNull())).first()[0]
    return df if bad else df.drop("_status", ERROR)


def ordered(columns: list[str], status: str = "_status") -> list[str]:
    """User columns, traces by name, credits, tokens, status and error. ``_trace`` alone counts as a user column."""
    last = [CREDITS, *TOKENS, "_status", ERROR]
    traces = [c for c in columns if c.startswith("_trace_")]
    return [c for c in columns if c not in last and c not in traces] + traces + [c for c in last if c in columns]


class Checkpoint:
    """Results by batch of pending rows, each a folder of its own, and the export at the end.

    A batch is durable once its ``_SUCCESS`` is there; a run that was cut off is resumed by leaving out the keys of
    durable batches. The batches lie beside the export, in ``<path>.batches``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key, self.root = spark, path, key, f"{path}.batches"

    def _folders(self) -> list[str]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [s.getPath() for s in fs.listStatus(where)]
        return sorted(f"{self.root}/{p.getName()}" for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def done(self, schema: T.StructType) -> DataFrame | None:
        folders = self._folders()
        return self.spark.read.schema(schema).parquet(*folders) if folders else None

    def save(self, batch: DataFrame) -> None:
        batch.write.parquet(f"{self.root}/batch-{len(self._folders()):06d}-{uuid.uuid4().hex[:8]}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def save_table(df: DataFrame, path: str) -> None:
    """One file for csv and xlsx (complex columns as JSON), a folder for parquet; written beside and then renamed."""
    ending = os.path.splitext(path)[1].lower()
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if ending == ".parquet":
        df.write.parquet(tmp)
        made = jvm.org.apache.hadoop.fs.Path(tmp)
    elif ending == ".csv":
        json_columns(df).coalesce(1).write.option("header", True).option("escape", '"').option("quoteAll", False).csv(tmp)
        made = next(s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(tmp)) if s.getPath().getName().startswith("part-"))
    elif ending == ".xlsx":
        json_columns(df).toPandas().to_excel(tmp + ".xlsx", index=False)
        made = jvm.org.apache.hadoop.fs.Path(tmp + ".xlsx")
    else:
        raise ValueError(f"'{ending}' is not one of .csv, .xlsx, .parquet")
    fs.delete(target, True)
    fs.rename(made, target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(tmp), True)

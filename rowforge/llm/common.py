"""Shared helpers: durable intermediate tables, free column names, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster that is an error, as executors would
    each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rowforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rowforge/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that make a file worth writing.
FILE_ROWS = 200_000


def sized(df: DataFrame, rows: int | None, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df`` in no more partitions than about ``rows`` rows need, but enough to keep all cores busy."""
    if rows is None:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // file_rows)))


#: What the operator that runs now has written and will not need when it is done: one list for each call within another.
_made: ContextVar[tuple[list[Callable[[], None]], ...]] = ContextVar("made", default=())


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def on_exit(undo: Callable[[], None], outer: bool = False) -> None:
    """Call ``undo`` when the running operator is done; with ``outer``, when the one that called it is, if any."""
    lists = _made.get()[:-1] if outer else _made.get()
    if lists:
        lists[-1].append(undo)


@contextmanager
def scratch():
    """Tables that are written inside are removed at the end, also after a failure, unless they are ``lasting``."""
    made: list[Callable[[], None]] = []
    token = _made.set((*_made.get(), made))
    try:
        yield
    finally:
        _made.reset(token)
        for undo in reversed(made):
            undo()


def cleans_up(f):
    """An operator whose result reads nothing but its input and lasting tables."""

    @wraps(f)
    def run(*args, **kwargs):
        with scratch():
            return f(*args, **kwargs)

    return run


def materialise(df: DataFrame, name: str, rows: int | None = None, file_rows: int = FILE_ROWS, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors: every later reader sees the same rows. ``rows``, where
    it is known, sizes the files: a table of few rows should not be as many files as an exchange has partitions. The
    table goes when the running operator is done; a ``lasting`` one is part of its result.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    on_exit(lambda: remove(spark, path), lasting)
    sized(df, rows, file_rows).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text):
    """Number of words of a text column; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def power_of_two(x: float, least: int = 1, most: int = 1 << 40) -> int:
    """The smallest power of two that is at least ``x``, within bounds."""
    return max(least, min(most, 1 << max(0, int(x - 1).bit_length() if x >= 1 else 0)))

"""Local containers in and out. A Spark DataFrame stays what it is."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The text column of what is not a table, and the column that keeps the order and the index.
TEXT, KEY = "_texto", "_key"


@dataclass(frozen=True)
class Origin:
    """What came in: its kind, its index or keys, and a series' name."""

    kind: str
    index: object = None
    name: str | None = None


def _polars(data) -> str | None:
    kind = type(data)
    return kind.__name__ if kind.__module__.split(".")[0] == "polars" else None


def to_spark(data, spark: SparkSession | None = None) -> tuple[DataFrame, Origin]:
    """A Spark table of a Spark, pandas or polars DataFrame, a Series, a list or a dict (values are the texts).

    Tables keep their columns, the others get ``_texto``; all but Spark's get ``_key``, the position.
    """
    if isinstance(data, DataFrame) or hasattr(data, "sparkSession"):
        return data, Origin("spark")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if isinstance(data, pd.DataFrame):
        return _table(spark, data), Origin("pandas", data.index)
    if (kind := _polars(data)) == "DataFrame":
        pdf = data.to_pandas()
        return _table(spark, pdf), Origin("polars", pdf.index)
    if isinstance(data, pd.Series):
        return _texts(spark, data.tolist()), Origin("series", data.index, data.name)
    if kind == "Series":
        return _texts(spark, data.to_list()), Origin("polars_series", None, data.name)
    if isinstance(data, list):
        return _texts(spark, data), Origin("list", pd.RangeIndex(len(data)))
    if isinstance(data, dict):
        return _texts(spark, list(data.values())), Origin("dict", pd.Index(list(data), dtype=object))
    raise TypeError(f"{type(data).__name__} is not one of: Spark, pandas or polars DataFrame, pandas or polars Series, list, dict")


def _texts(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], f"{KEY} long, {TEXT} string")


def _table(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    pdf = pdf.reset_index(drop=True)
    kept = pdf.astype(object).where(pdf.notna(), None)
    for c in pdf.columns:
        if pdf[c].dtype != object:
            kept[c] = pdf[c]
        elif not pdf[c].notna().any():
            kept[c] = pd.Series([None] * len(pdf), dtype="string")
    kept.insert(0, KEY, range(len(pdf)))
    kept.columns = [str(c) for c in kept.columns]
    return spark.createDataFrame(kept)


def from_spark(df: DataFrame, origin: Origin):
    """Back to what came in: Spark stays; the rest is collected in its order, as a DataFrame without ``_texto``."""
    if origin.kind == "spark":
        return df
    pdf = df.orderBy(F.col(KEY)).drop(KEY).toPandas()
    if origin.kind in ("series", "list", "dict", "polars_series"):
        pdf = pdf.drop(columns=TEXT)
    if origin.index is not None and len(origin.index) == len(pdf):
        pdf.index = origin.index
    if origin.kind.startswith("polars"):
        import polars

        return polars.from_pandas(pdf)
    return pdf

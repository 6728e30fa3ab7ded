"""Tables from files, by their ending."""

from __future__ import annotations

import os

from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession

from ..errors import check_dependency
from ..functions.schema import complex_fields, struct_of
from ..functions.text import keep_unparsed, normalize_all


def read_table(path: str, model: type[BaseModel] | None = None, normalize: bool = True, spark: SparkSession | None = None, **options) -> DataFrame:
    """Read .csv, .parquet, .json, .xlsx or .xls; ``options`` go to the reader.

    With ``normalize``, JSON strings become typed columns: those of the model's complex fields (what does not parse is
    kept in ``<name>_raw``), or without a model those that read like JSON (typed where all cells agree, else VARIANT). ``FileNotFoundError`` for a missing file, ``ValueError`` for another ending.
    A .json file holds an array of records; with ``orient="columns"`` a dict of columns, as pandas writes it.
    """
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending == ".csv":
        df = spark.read.options(**{"header": True, "inferSchema": True, "multiLine": True, "escape": '"'} | options).csv(path)
    elif ending == ".parquet":
        df = spark.read.options(**options).parquet(path)
    elif ending == ".json":
        df = _json(spark, path, **options)
    elif ending in (".xlsx", ".xls"):
        df = _excel(spark, path, **options)
    else:
        raise ValueError(f"'{ending}' is not one of .csv, .parquet, .json, .xlsx, .xls")
    if not normalize:
        return df
    if model is None:
        return normalize_all(df)
    kinds = struct_of(model)
    return keep_unparsed(df, {n: kinds[n].dataType for n in complex_fields(model)})


def _json(spark: SparkSession, path: str, orient: str = "records", **options) -> DataFrame:
    if orient == "columns":
        import pandas as pd

        return spark.createDataFrame(pd.read_json(path, **options))
    return spark.read.options(**{"multiLine": True} | options).json(path)


def _excel(spark: SparkSession, path: str, **options) -> DataFrame:
    """A sheet is read by the driver; it is small by its format's limits."""
    import pandas as pd

    old = path.lower().endswith(".xls")
    check_dependency(*(("xlrd", "xlrd") if old else ("openpyxl", "openpyxl")))
    return spark.createDataFrame(pd.read_excel(path, **options))

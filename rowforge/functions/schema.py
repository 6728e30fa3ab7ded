"""Spark types of Pydantic models."""

from __future__ import annotations

import datetime
import decimal
import json
import types
import typing

from pydantic import BaseModel
from pyspark.sql import types as T

_SCALARS = {
    str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(),
    datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18),
}


def is_model(annotation) -> bool:
    return isinstance(annotation, type) and issubclass(annotation, BaseModel)


def options_of(annotation) -> list:
    """The members of a union without None; else the annotation alone."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        return [a for a in typing.get_args(annotation) if a is not type(None)]
    return [annotation]


def models_in(annotation) -> list[type[BaseModel]]:
    """All models that an annotation mentions, at any depth of containers and unions."""
    if is_model(annotation):
        return [annotation]
    return [m for a in typing.get_args(annotation) for m in models_in(a)]


def list_item_model(annotation) -> type[BaseModel] | None:
    """The model of a list of models, also if optional."""
    for a in options_of(annotation):
        if typing.get_origin(a) is list and typing.get_args(a) and is_model(typing.get_args(a)[0]):
            return typing.get_args(a)[0]
    return None


def is_complex(annotation) -> bool:
    """Whether a value is a list, dict or tuple, also inside a union. A nested model is not."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        return any(is_complex(a) for a in typing.get_args(annotation))
    return (typing.get_origin(annotation) or annotation) in (list, dict, tuple)


def complex_fields(model: type[BaseModel]) -> set[str]:
    """Names of the fields with complex types."""
    return {n for n, f in model.model_fields.items() if is_complex(f.annotation)}


def spark_type(annotation, inside: tuple = ()) -> T.DataType:
    """The column type of an annotation; a JSON string where there is none.

    Recursive models, unions of several types, and containers of unknown element are JSON strings.
    """
    members = options_of(annotation)
    if len(members) != 1:
        return T.StringType()
    (a,) = members
    origin, args = typing.get_origin(a), typing.get_args(a)
    if a in _SCALARS:
        return _SCALARS[a]
    if origin is typing.Annotated:
        return spark_type(args[0], inside)
    if origin is typing.Literal:
        kinds = {type(x) for x in args}
        return _SCALARS.get(kinds.pop(), T.StringType()) if len(kinds) == 1 else T.StringType()
    if is_model(a):
        if a in inside or _loops(a):
            return T.StringType()
        return T.StructType([T.StructField(n, spark_type(f.annotation, (*inside, a))) for n, f in a.model_fields.items()])
    if origin is list and args and not _untyped(args[0]):
        return T.ArrayType(spark_type(args[0], inside))
    if origin is dict and len(args) == 2 and args[0] is str and not _untyped(args[1]):
        return T.MapType(T.StringType(), spark_type(args[1], inside))
    if origin is tuple and args:
        if len(args) == 2 and args[1] is Ellipsis:
            return T.ArrayType(spark_type(args[0], inside))
        return T.StructType([T.StructField(f"_{i}", spark_type(x, inside)) for i, x in enumerate(args, 1)])
    return T.StringType()


def _untyped(annotation) -> bool:
    return annotation in (dict, list, tuple, object, typing.Any)


def _loops(model: type[BaseModel], path: tuple = ()) -> bool:
    if model in path:
        return True
    return any(_loops(m, (*path, model)) for f in model.model_fields.values() for m in models_in(f.annotation))


def struct_of(model: type[BaseModel]) -> T.StructType:
    """One nullable column for each field; ``ValueError`` for a model without fields."""
    if not model.model_fields:
        raise ValueError("the model has no fields")
    return T.StructType([T.StructField(n, spark_type(f.annotation)) for n, f in model.model_fields.items()])


def cell(value, kind: T.DataType):
    """A dumped value as the Arrow cell of its column."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    if isinstance(kind, T.ArrayType):
        return [cell(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(str(k), cell(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            value = dict(zip(kind.fieldNames(), value, strict=False))
        return {f.name: cell(value.get(f.name), f.dataType) for f in kind.fields}
    return value

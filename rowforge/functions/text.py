"""Prompts and JSON in text columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOT = "{texto}"


def template(prompt: str) -> str:
    """A prompt with a place for the text; added at the end if it has none. ``{text}`` is read as ``{texto}``."""
    prompt = prompt if SLOT in prompt else prompt.replace("{text}", SLOT)
    return prompt if SLOT in prompt else prompt.rstrip() + "\n\nTexto a analisar:\n" + SLOT


def build_prompt(prompt: str, text: str) -> str:
    """Every place of the template filled with the text; other braces stay."""
    return text.join(prompt.split(SLOT))


def prompt_column(prompt: str, text: Column) -> Column:
    return F.replace(F.lit(template(prompt)), F.lit(SLOT), text)


_FENCE = re.compile(r"```json\s*\n(.*?)\n\s*```", re.DOTALL)


def parse_json(reply):
    """The JSON of a reply: in a fence, else from the first { to the last }, else all of it.

    A reply may be an object with ``content``, text or a list of text blocks.
    """
    text = getattr(reply, "content", reply)
    if isinstance(text, list):
        text = "".join(x if isinstance(x, str) else x.get("text", "") for x in text)
    if m := _FENCE.search(text):
        found = m[1]
    else:
        lo, hi = text.find("{"), text.rfind("}")
        found = text[lo : hi + 1] if 0 <= lo < hi else text.strip()
    try:
        return json.loads(found)
    except ValueError as e:
        raise ValueError(f"no JSON in the reply: {text[:200]}") from e


def json_part(reply: Column) -> Column:
    """The same choice as ``parse_json``, as text."""
    fence = r"(?s)```json\s*\n(.*?)\n\s*```"
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).when(braces != "", braces).otherwise(F.regexp_replace(reply, r"^\s+|\s+$", ""))


def parse_json_column(reply: Column, schema: str | T.DataType) -> Column:
    """The reply's JSON as a typed value; null where it has none."""
    return F.from_json(json_part(reply), schema)


def normalize_value(value):
    """A string that reads like a JSON array or object as its value; all else, and what does not parse, as it is."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def typed_json(value: Column, kind: T.DataType) -> Column:
    """A JSON string as a column type; a JSON array becomes a struct of its places where the type is one of a tuple."""
    if isinstance(kind, T.StructType) and kind.fieldNames() and all(n == f"_{i}" for i, n in enumerate(kind.fieldNames(), 1)):
        items = F.from_json(value, "array<string>")
        fields = [
            (F.get(items, F.lit(i)).try_cast(f.dataType) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else typed_json(F.get(items, F.lit(i)), f.dataType)).alias(f.name)
            for i, f in enumerate(kind.fields)
        ]
        return F.when(items.isNotNull(), F.struct(*fields))
    # a struct of what is no JSON would be one of nulls
    return F.when(F.try_parse_json(value).isNotNull(), F.from_json(value, kind))


def normalize_columns(df: DataFrame, kinds: dict[str, T.DataType], keep_raw: bool = False) -> DataFrame:
    """String columns of JSON as their types; columns that are missing or typed already are left alone.

    What does not parse is null; with ``keep_raw`` it stays in ``<name>_raw``.
    """
    for name, kind in kinds.items():
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType) and not isinstance(kind, T.StringType):
            value = typed_json(F.col(f"`{name}`"), kind)
            if keep_raw:
                df = df.withColumn(f"{name}_raw", F.when(value.isNull(), F.col(f"`{name}`")))
            df = df.withColumn(name, value)
    return df


def keep_unparsed(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """``normalize_columns`` without loss: where a cell does not parse, its text is in ``<name>_raw``; columns of that
    name that would be null in all rows are left out."""
    out = normalize_columns(df, kinds, keep_raw=True)
    raw = [c for c in out.columns if c not in df.columns]
    if not raw:
        return out
    held = out.agg(*[F.count(F.col(f"`{c}`")) for c in raw]).first()
    return out.drop(*[c for c, n in zip(raw, held, strict=True) if not n])


def normalize_all(df: DataFrame) -> DataFrame:
    """Every string column with a cell that reads like a JSON array or object and parses, without loss.

    Two jobs look at all rows of all columns. Where every cell parses and cells of a place agree in their type, the column
    gets the type of all cells together (keys that a cell does not have are null). Else it is a VARIANT: each cell is its
    own JSON value, and what does not parse is the string that it was. Other columns stay; so do those of an empty table.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(c.rlike(r"^\s*[\[{]"), F.try_parse_json(c))

    seen = df.agg(*[F.count(value(n)) for n in names], *[F.count(F.col(f"`{n}`")) for n in names]).first()
    found = [(n, seen[i] == seen[len(names) + i]) for i, n in enumerate(names) if seen[i]]
    if not found:
        return df
    kinds = df.agg(*[F.schema_of_variant_agg(value(n)) for n, _ in found]).first()
    out = {}
    for (name, all_parse), kind in zip(found, kinds, strict=True):
        c = F.col(f"`{name}`")
        if all_parse and not any(x in kind for x in ("VARIANT", "VOID", "OBJECT<>")):
            out[name] = F.from_json(c, kind.replace("OBJECT<", "STRUCT<"))
        else:
            out[name] = F.coalesce(value(name), c.cast("variant"))
    return df.withColumns(out)


def json_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps, structs and variants as JSON strings, nulls kept: for sinks of plain values."""
    complex_ = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    return df.withColumns({n: F.to_json(F.col(f"`{n}`"), {"ignoreNullFields": "false"}) for n in complex_}) if complex_ else df

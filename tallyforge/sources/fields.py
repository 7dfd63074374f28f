"""Fields of service responses of any nesting, unwrapped to leaves in one pass."""

from __future__ import annotations

import json as js
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What a field's value is looked up under, in this order, when it is neither a list nor an object.
TYPED = (
    "valueString",
    "valueNumber",
    "valueInteger",
    "valueDate",
    "valueTime",
    "valueCurrency",
    "valueAddress",
    "valuePhoneNumber",
    "valueCountryRegion",
    "content",
)
# Leaves that are handed on at once, and nesting that one value may have.
BLOCK, NESTED = 10_000, 10_000
_KNOWN = frozenset(TYPED)
_LEAF = "path string, __text string, __raw string, __day boolean, __sure string"


class _Number(str):
    """A number as it is written."""


_read = js.JSONDecoder(parse_int=_Number, parse_float=_Number).raw_decode


def _json(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{js.dumps(k)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return str(value) if isinstance(value, _Number) else js.dumps(value)


def _text(value) -> tuple[str | None, str | None]:
    """A value's text, or else the JSON that Spark has to write in its form."""
    kind = type(value)
    if kind is str or value is None:
        return value, None
    if kind is bool or kind is _Number and value.isdigit() and len(value) < 19:
        return _json(value), None
    return None, _json(value)


def _leaf(field) -> tuple[str | None, str | None, bool, str | None]:
    """Of a field that is no list and no object: its first typed value, `value`, or the whole field, and its confidence.

    A currency is its amount, or none; a date is to be cut.
    """
    if type(field) is not dict:
        return *_text(field), False, None
    sure = field.get("confidence")
    sure = None if sure is None else _json(sure)
    for name in TYPED if len(field) > 1 else _KNOWN.intersection(field):
        if (value := field.get(name)) is not None:
            if name == "valueCurrency" and type(value) is dict:
                value = value.get("amount")
            return *_text(value), name == "valueDate", sure
    return *_text(field["value"] if "value" in field else field), False, sure


def _leaves(field) -> Iterator[tuple]:
    """Path and leaf of each leaf below a field, which waits on a list of its own: nesting has no limit here."""
    waiting = [("", field)]
    while waiting:
        path, field = waiting.pop()
        listed = type(field) is dict and "valueArray" in field
        if not listed and not (type(field) is dict and "valueObject" in field):
            yield path, *_leaf(field)
            continue
        inner = field["valueArray" if listed else "valueObject"]
        if path is None:
            inner = list(inner.values()) if type(inner) is dict else inner
            waiting.extend([(None, x) for x in inner] if type(inner) is list else [])
        elif listed and type(inner) is list:
            waiting.extend([(f"{path}[{i}]", x) for i, x in enumerate(inner)])
        elif listed and type(inner) is dict:  # in the order of Spark's variants
            names = sorted(inner, key=lambda n: n.encode("utf-16-be", "surrogatepass"))
            waiting.extend([(f"{path}[{i}]", inner[n]) for i, n in enumerate(names)])
        elif type(inner) is dict:
            dot = f"{path}." if path else ""
            waiting.extend([(dot + n, x) for n, x in inner.items()])
        elif type(inner) is list:  # a list of fields without names has no paths
            waiting.extend([(None, x) for x in inner])


def _utf8(texts: tuple) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:  # half a pair of surrogates is a question mark, as in Spark
        return pa.array([t if t is None else t.encode("utf-8", "replace").decode() for t in texts], pa.string())


def _unwrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the responses in the last column, with the other columns."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), NESTED))

    def block(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        path, text, raw, day, sure = zip(*found, strict=True)
        own = [_utf8(path), _utf8(text), _utf8(raw), pa.array(day, pa.bool_()), _utf8(sure)]
        rows = pa.array(at, pa.int64())
        kept = [c.take(rows) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*kept, *own], names=[*batch.schema.names[:-1], "path", "__text", "__raw", "__day", "__sure"])

    for batch in batches:
        at, found = [], []
        for i, text in enumerate(batch.columns[-1]):
            for leaf in _leaves(_read(text.as_py().lstrip(" \t\r\n"))[0]):
                at.append(i)
                found.append(leaf)
                if len(at) >= BLOCK:
                    yield block(batch, at, found)
                    at, found = [], []
        if at:
            yield block(batch, at, found)


def unwrapped(responses: DataFrame, json: str = "json") -> DataFrame:
    """The columns of responses but the JSON, with path, value and confidence of each leaf field, however deep.

    A field with `valueArray` is a list of fields, else one with `valueObject` an object of fields, else a leaf. The text
    may be one field, or an object or list of fields as they stand in a response (`fields`). Paths are names and places:
    `Accounts[0].Transactions[2].Date`. One pass takes each response from its text to its leaves; nothing is written.
    Empty lists and objects give no leaf; text that is no JSON gives none; values of null leaves are null. Texts are as
    Spark's variants write them: it reads each response, and numbers and objects among the values, by itself.
    """
    keep = [c for c in responses.columns if c != json]
    known = responses.filter(F.try_parse_json(json).isNotNull()).select(*keep, json)
    kind = StructType([*known.select(*keep).schema.fields, *StructType.fromDDL(_LEAF).fields])
    found = known.mapInArrow(_unwrapped, kind)
    text = F.when(F.col("__raw").isNotNull(), F.to_json(F.try_parse_json("__raw"))).otherwise(F.col("__text"))
    sure = F.try_variant_get(F.try_parse_json("__sure"), "$", "double")
    return found.select(*keep, "path", F.when(F.col("__day"), F.substring(text, 1, 10)).otherwise(text).alias("value"), sure.alias("confidence"))

"""JSON in text columns. Paths are $.a.b[0]; results that are JSON have sorted keys and no spaces."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.sources.workers import python_ready

_STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]")


def steps(path: str) -> list[str | int] | None:
    """The keys and positions of a path; None if it is none."""
    if not path.startswith("$") or "".join(m[0] for m in _STEP.finditer(path)) != path[1:]:
        return None
    return [m[1] if m[1] is not None else int(m[2]) for m in _STEP.finditer(path)]


def extract(j: Column, path: str) -> Column:
    """The JSON text at a path: texts in quotes, and null both for JSON null and for a missing key. SQL null for broken JSON."""
    parsed = F.try_parse_json(j)
    return F.when(parsed.isNotNull(), F.coalesce(F.to_json(F.try_variant_get(parsed, path, "variant")), F.lit("null")))


def unquote(j: Column) -> Column:
    """A JSON text without its quotes and escapes; anything else as it is."""
    return F.when(j.rlike(r'(?s)^".*"$'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v"), j)).otherwise(j)


def extract_text(j: Column, path: str) -> Column:
    """What ->> does."""
    return unquote(extract(j, path))


def valid(j: Column) -> Column:
    return F.when(j.isNotNull(), F.try_parse_json(j).isNotNull().cast("int"))


def type_of(j: Column) -> Column:
    """NULL, BOOLEAN, INTEGER, DOUBLE, STRING, ARRAY or OBJECT; numbers with no fraction are integers. Null for broken JSON."""
    kind = F.schema_of_variant(F.try_parse_json(j))
    number = F.try_variant_get(F.try_parse_json(j), "$", "double")
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind == "VOID", "NULL")
        .when(kind == "BOOLEAN", "BOOLEAN")
        .when(kind == "STRING", "STRING")
        .when(kind.startswith("ARRAY"), "ARRAY")
        .when(kind.startswith("OBJECT"), "OBJECT")
        .when(number == F.floor(number), "INTEGER")
        .otherwise("DOUBLE")
    )


def length(j: Column, path: str = "$") -> Column:
    """Elements of an array, keys of an object, 1 for others; null for broken JSON and a missing path."""
    part = j if path == "$" else F.to_json(F.try_variant_get(F.try_parse_json(j), path, "variant"))
    kind = type_of(part)
    return F.when(kind == "ARRAY", F.json_array_length(part)).when(kind == "OBJECT", F.size(F.json_object_keys(part))).when(kind.isNotNull(), F.lit(1))


def keys(j: Column, path: str = "$") -> Column:
    """An object's keys as a sorted JSON array; null for others."""
    part = j if path == "$" else F.to_json(F.try_variant_get(F.try_parse_json(j), path, "variant"))
    return F.when(type_of(part) == "OBJECT", F.to_json(F.array_sort(F.json_object_keys(part))))


def array(*values: Column) -> Column:
    """A JSON array of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *(literal(v) for v in values)), F.lit("]"))


def object(*pairs: tuple[str, Column]) -> Column:
    """A JSON object with its keys sorted; the last value of a key counts."""
    known = dict(pairs)
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), literal(known[k])) for k in sorted(known)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def literal(value: Column) -> Column:
    """A value as JSON text, whatever its type."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.coalesce(F.nullif(F.substring(text, 6, 2**31 - 1), F.lit("")).substr(F.lit(1), F.length(text) - 6), F.lit("null"))


def _dump(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _load(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def _put(value, path: list, new):
    """value with new at path. What is in the way becomes an object or array; arrays grow by nulls up to the position."""
    if not path:
        return new
    step, rest = path[0], path[1:]
    if isinstance(step, str):
        own = value if isinstance(value, dict) else {}
        return own | {step: _put(own.get(step), rest, new)}
    own = list(value) if isinstance(value, list) else []
    own += [None] * (step + 1 - len(own))
    own[step] = _put(own[step], rest, new)
    return own


def _cut(value, path: list):
    if not path:
        return None
    step, rest = path[0], path[1:]
    if isinstance(step, str) and isinstance(value, dict) and step in value:
        return {k: _cut(v, rest) if k == step else v for k, v in value.items() if rest or k != step}
    if isinstance(step, int) and isinstance(value, list) and step < len(value):
        return [*value[:step], *([_cut(value[step], rest)] if rest else []), *value[step + 1 :]]
    return value


def _within(target, candidate) -> bool:
    if isinstance(target, list):
        return any(x == candidate for x in target)
    if isinstance(target, dict) and isinstance(candidate, dict):
        return all(k in target and target[k] == v for k, v in candidate.items())
    return target == candidate


def put(j: Column, path: str, value: Column) -> Column:
    """JSON_SET: the JSON with a value, itself JSON text, at a path; unchanged for a broken path, null for broken JSON."""
    way = steps(path)
    python_ready()

    @F.pandas_udf("string")
    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text, new):
            fine, own = _load(text)
            known, new = _load(new)
            return _dump(own if way is None else _put(own, way, new)) if fine and known else None

        return pd.Series([one(a, b) for a, b in zip(texts, values, strict=True)], dtype="object")

    return run(j, value)


def remove(j: Column, *paths: str) -> Column:
    """JSON_REMOVE: the JSON without what stands at the paths; $ leaves null, broken paths change nothing. Null for broken JSON."""
    ways = [steps(p) for p in paths]
    python_ready()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            fine, own = _load(text)
            if not fine:
                return None
            for w in ways:
                own = own if w is None else _cut(own, w)
            return _dump(own)

        return pd.Series([one(x) for x in texts], dtype="object")

    return run(j)


def contains(j: Column, candidate: Column, path: str = "$") -> Column:
    """JSON_CONTAINS: 1 if an array has an equal element, an object the same keys and values, or the values are equal; else 0."""
    way = steps(path)
    python_ready()

    @F.pandas_udf("int")
    def run(texts: pd.Series, others: pd.Series) -> pd.Series:
        def one(text, other):
            fine, own = _load(text)
            known, other = _load(other)
            if not fine or not known or way is None:
                return 0
            for step in way:
                try:
                    own = own[step]
                except (KeyError, IndexError, TypeError):
                    own = None
            return int(_within(own, other))

        return pd.Series([one(a, b) for a, b in zip(texts, others, strict=True)], dtype="Int32")

    return run(j, candidate)

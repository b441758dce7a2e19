"""JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import json as J
from tidewater.plans.registry import query
from tidewater.sources.tables import read

_JSON = ['{"a": {"b": [1, "x", null, {"c": true}]}, "s": "it \\"is\\"", "n": 2.5, "i": 3}', "[1, 2, 3]", '"text"', "12", "true", "null", "{broken", "", None, '{"b": 1, "a": 2}']


def _rows(spark):
    return spark.createDataFrame([(k, j) for k, j in enumerate(_JSON)], "id int, j string")


def _values() -> str:
    quoted = ", ".join(f"({k}, {'null' if j is None else chr(39) + j.replace(chr(39), chr(39) * 2) + chr(39)})" for k, j in enumerate(_JSON))
    return f"(values {quoted}) t(id, j)"


def _expected(name: str, values: list, kind: str, expression) -> None:
    """A query over the JSON cases, held against the values that these must give, by id."""
    shown = ", ".join(f"({k}, {'null' if v is None else v if isinstance(v, int) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)})" for k, v in enumerate(values))

    @query(f"select id, cast(v as {kind}) as v from (values {shown}) t(id, v)", name=name)
    def run(spark, d):
        return _rows(spark).select("id", expression(F.col("j")).alias("v"))


@query("""select event_id, json_extract(props, '$.k')::varchar as v, coalesce(json_extract(props, '$.missing')::varchar, 'null') as missing from events""")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", J.extract(F.col("props"), "$.k").alias("v"), J.extract(F.col("props"), "$.missing").alias("missing"))


_expected("json_extract_paths", ["\"x\"", "null", "null", "null", "null", "null", None, None, None, "null"], "varchar", lambda j: J.extract(j, "$.a.b[1]"))
_expected("json_extract_root", ['{"a":{"b":[1,"x",null,{"c":true}]},"i":3,"n":2.5,"s":"it \\"is\\""}', "[1,2,3]", '"text"', "12", "true", "null", None, None, None, '{"a":2,"b":1}'], "varchar", lambda j: J.extract(j, "$"))
_expected("json_unquote", ['it "is"', "null", "null", "null", "null", "null", None, None, None, "null"], "varchar", lambda j: J.unquote(J.extract(j, "$.s")))
_expected("json_darrow", ["3", "null", "null", "null", "null", "null", None, None, None, "null"], "varchar", lambda j: J.extract_text(j, "$.i"))
_expected("json_type", ["OBJECT", "ARRAY", "STRING", "INTEGER", "BOOLEAN", "NULL", None, None, None, "OBJECT"], "varchar", J.type_of)
_expected("json_valid", [1, 1, 1, 1, 1, 1, 0, 0, None, 1], "integer", J.valid)
_expected("json_length", [4, 3, 1, 1, 1, 1, None, None, None, 2], "integer", J.length)
_expected("json_length_path", [4, None, None, None, None, None, None, None, None, None], "integer", lambda j: J.length(j, "$.a.b"))
_expected("json_keys", ['["a","i","n","s"]', None, None, None, None, None, None, None, None, '["a","b"]'], "varchar", J.keys)
_expected("json_set", ['{"a":{"b":[1,"x",null,{"c":true}]},"i":3,"n":2.5,"s":"it \\"is\\"","z":9}', '{"z":9}', '{"z":9}', '{"z":9}', '{"z":9}', '{"z":9}', None, None, None, '{"a":2,"b":1,"z":9}'], "varchar", lambda j: J.put(j, "$.z", F.lit("9")))
_expected("json_set_deep", ['{"a":{"b":[1,"new",null,{"c":true}]},"i":3,"n":2.5,"s":"it \\"is\\""}', *['{"a":{"b":[null,"new"]}}'] * 5, None, None, None, '{"a":{"b":[null,"new"]},"b":1}'], "varchar", lambda j: J.put(j, "$.a.b[1]", F.lit('"new"')))
_expected("json_remove", ['{"a":{"b":[1,null,{"c":true}]},"n":2.5,"s":"it \\"is\\""}', "[1,2,3]", '"text"', "12", "true", "null", None, None, None, '{"a":2,"b":1}'], "varchar", lambda j: J.remove(j, "$.i", "$.a.b[1]"))
_expected("json_contains", [0, 1, 0, 0, 0, 0, 0, 0, 0, 0], "integer", lambda j: J.contains(j, F.lit("2")))
_expected("json_contains_object", [0, 0, 0, 0, 0, 0, 0, 0, 0, 1], "integer", lambda j: J.contains(j, F.lit('{"b": 1}')))


@query("select p_partkey, '[' || p_size || ',' || to_json(p_name)::varchar || ',null,true]' as v from part")
def json_array(spark, d):
    return read(spark, d, "part").select("p_partkey", J.array(F.col("p_size"), F.col("p_name"), F.lit(None).cast("string"), F.lit(True)).alias("v"))


@query("select p_partkey, '{\"name\":' || to_json(p_name)::varchar || ',\"size\":' || p_size || '}' as v from part")
def json_object(spark, d):
    return read(spark, d, "part").select("p_partkey", J.object(("size", F.col("p_size")), ("name", F.col("p_name"))).alias("v"))


@query("select json_extract_string(props, '$.k') as k, count(*) as n, round(avg(value), 6) as mean from events group by json_extract_string(props, '$.k')")
def json_group(spark, d):
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))

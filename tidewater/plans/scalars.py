"""Scalar functions over table columns, and over edge cases given as values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import conditional as C
from tidewater.functions import dates as D
from tidewater.functions import math as M
from tidewater.functions import strings as S
from tidewater.plans.registry import query
from tidewater.sources.tables import read

_EDGES = "(values ('Hello'), ('héé'), (''), ('  pad\t'), ('O''Neil-mc donald'), (null)) t(s)"


def edges(spark):
    return spark.createDataFrame([("Hello",), ("héé",), ("",), ("  pad\t",), ("O'Neil-mc donald",), (None,)], "s string")


def _text(name: str, sql: str, expression, table: tuple[str, str, str] = ("part", "p_partkey", "p_name")) -> None:
    """A query of a text function over a table's column, and one over the edge cases where sql names its column s."""
    t, key, col = table

    @query(f"select {key}, {sql.replace('$s', col)} as v from {t}", name=name)
    def over_table(spark, d):
        return read(spark, d, t).select(key, expression(F.col(col)).alias("v"))

    @query(f"select s, {sql.replace('$s', 's')} as v from {_EDGES}", name=f"{name}_edges")
    def over_edges(spark, d):
        return edges(spark).select("s", expression(F.col("s")).alias("v"))


_text("substr", "case when $s is null then null else substr($s, case when -3 < 0 then greatest(length($s) - 2, 1) end, 2) end", lambda s: S.substr(s, -3, 2))
_text("substr_from_zero", "substr($s, 1, 3)", lambda s: S.substr(s, 0, 3))
_text("substr_before_start", "substr($s, 1, 3)", lambda s: S.substr(s, -100, 3))
_text("length", "cast(length($s) as integer)", lambda s: F.length(s))
_text("upper", "upper($s)", lambda s: F.upper(s))
_text("lower", "lower($s)", lambda s: F.lower(s))
_text("concat", "concat($s, '-', null, 7)", lambda s: S.concat(s, F.lit("-"), F.lit(None), F.lit(7)))
_text("concat_ws", "concat_ws('|', $s, null, 'x')", lambda s: S.concat_ws(F.lit("|"), s, F.lit(None), F.lit("x")))
_text("trim", "trim($s, ' ' || chr(9) || chr(10) || chr(13))", lambda s: S.trim(s))
_text("ltrim", "ltrim($s, 'Hgabs ')", lambda s: S.ltrim(s, "Hgabs "))
_text("rtrim", "rtrim($s, 'odne ' || chr(9))", lambda s: S.rtrim(s, "odne \t"))
_text("left", "left($s, 3)", lambda s: S.left(s, 3))
_text("right", "right($s, 3)", lambda s: S.right(s, 3))
_text("repeat", "repeat($s, 2)", lambda s: F.repeat(s, F.lit(2)))
_text("replace", "replace($s, 'e', '<>')", lambda s: F.replace(s, F.lit("e"), F.lit("<>")))
_text("reverse", "reverse($s)", lambda s: F.reverse(s))
_text("initcap", "list_aggregate(list_transform(regexp_extract_all($s, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), 'string_agg', '')".replace("list_aggregate(", "coalesce(list_aggregate(") + ", case when $s is not null then '' end)", lambda s: S.initcap(s))
_text("quote", "coalesce('''' || replace($s, '''', '''''') || '''', 'NULL')", lambda s: S.quote(s))
_text("lpad", "lpad($s, 8, '*-')", lambda s: S.lpad(s, 8, "*-"))
_text("rpad", "rpad($s, 8, '*-')", lambda s: S.rpad(s, 8, "*-"))
_text("position", "cast(position('l' in $s) as integer)", lambda s: S.position(F.lit("l"), s))
_text("instr", "cast(instr($s, 'el') as integer)", lambda s: S.instr(F.lit("el"), s))
_text("ascii", "case when $s = '' then 0 when $s is not null then cast(('0x' || substr(hex(encode($s)), 1, 2)) as integer) end", lambda s: S.ascii(s))


@query("select x, l, case when l = '' then 0 else coalesce(list_position(string_split(l, ','), x), 0) end as v from (values ('b', 'a,b,c'), ('d', 'a,b'), ('', ''), ('a', 'a')) t(x, l)")
def find_in_set(spark, d):
    rows = spark.createDataFrame([("b", "a,b,c"), ("d", "a,b"), ("", ""), ("a", "a")], "x string, l string")
    return rows.select("x", "l", S.find_in_set(F.col("x"), F.col("l")).alias("v"))


@query("select n, chr(n) as v from (values (65), (233), (8364), (128512)) t(n)")
def chr(spark, d):
    return spark.sql("select * from values (65), (233), (8364), (128512) as t(n)").select("n", S.chr(F.col("n")).alias("v"))


@query("select s_suppkey, repeat(' ', s_nationkey) as v from supplier")
def space(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", S.space(F.col("s_nationkey")).alias("v"))


@query("select c_custkey, format('{:,.2f}', c_acctbal) as en, replace(replace(replace(format('{:,.2f}', c_acctbal), ',', '#'), '.', ','), '#', '.') as de, replace(replace(format('{:,.2f}', c_acctbal), ',', ' '), '.', ',') as fr from customer")
def format(spark, d):
    x = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", S.format_number(x, 2).alias("en"), S.format_number(x, 2, "de_DE").alias("de"), S.format_number(x, 2, "fr_FR").alias("fr"))


_X = "(values (7.0, 2.0), (-7.0, 2.0), (2.5, 0.0), (-2.5, 3.0), (0.0, 10.0), (100.0, 10.0), (null, 1.0), (0.5, 1.0)) t(x, y)"
_Y = _X.replace("(values", "(select x::double as x, y::double as y from (values").replace(") t(x, y)", ") u(x, y)) t")


def _number(name: str, sql: str, expression, tolerance: int | None = 9) -> None:
    """A query of a number function over values with edge cases, and over prices and sizes."""
    shown = (lambda c: F.round(c, tolerance)) if tolerance is not None else (lambda c: c)
    wrapped = f"round({sql}, {tolerance})" if tolerance is not None else sql

    @query(f"select x, y, {wrapped} as v from {_Y}", name=name)
    def over_values(spark, d):
        rows = spark.sql(f"select cast(x as double) as x, cast(y as double) as y from {_X.replace('(values', 'values').replace(') t(x, y)', ' as t(x, y)')}")
        return rows.select("x", "y", shown(expression(F.col("x"), F.col("y"))).alias("v"))

    @query(f"select l_orderkey, l_linenumber, {wrapped} as v from (select l_orderkey, l_linenumber, l_extendedprice as x, l_quantity as y from lineitem)", name=f"{name}_lineitem")
    def over_table(spark, d):
        rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
        return rows.select("l_orderkey", "l_linenumber", shown(expression(F.col("x"), F.col("y"))).alias("v"))


_number("abs", "abs(x)", lambda x, y: F.abs(x), None)
_number("round", "round(x * 2) / 2", lambda x, y: M.round(x * 2) / 2)
_number("mod", "case when y <> 0 then x - trunc(x / y) * y end", lambda x, y: M.mod(x, y), 6)
_number("power", "power(y, 2)", lambda x, y: M.power(y, F.lit(2.0)))
_number("sqrt", "case when x >= 0 then sqrt(x) end", lambda x, y: M.sqrt(x))
_number("exp", "exp(y / 100)", lambda x, y: F.exp(y / 100))
_number("ln", "case when x > 0 then ln(x) end", lambda x, y: M.ln(x))
_number("log10", "case when x > 0 then log10(x) end", lambda x, y: M.log10(x))
_number("log", "case when y > 0 and y <> 1 and x > 0 then ln(x) / ln(y) end", lambda x, y: M.log(x, y))
_number("ceil", "ceil(x / 3)", lambda x, y: M.ceil(x / 3), None)
_number("floor", "floor(x / 3)", lambda x, y: M.floor(x / 3), None)
_number("trunc", "trunc(cast(x as decimal(38, 10)) * 10)::double / 10", lambda x, y: M.trunc(x, 1))
_number("trunc_tens", "trunc(x / 10) * 10", lambda x, y: M.trunc(x, -1))
_number("sign", "cast(sign(x) as integer)", lambda x, y: M.sign(x), None)
_number("greatest", "greatest(x, y, 3.0)", lambda x, y: M.greatest(x, y, F.lit(3.0)), None)
_number("least", "least(x, y, 3.0)", lambda x, y: M.least(x, y, F.lit(3.0)), None)


@query("select cast(count(*) as bigint) as n, true as in_range from nation")
def random(spark, d):
    return read(spark, d, "nation").withColumn("r", M.random()).agg(F.count(F.lit(1)).alias("n"), F.min((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"))


@query("select true as now_is_near, true as today, true as time_of_day, true as local")
def now(spark, d):
    near = F.abs(F.unix_seconds(D.now()) - F.unix_seconds(F.current_timestamp())) < 5
    return spark.range(1).select(near.alias("now_is_near"), (F.current_date() >= F.lit("2024-01-01").cast("date")).alias("today"), D.current_time().between(0, D.MICROS_A_DAY - 1).alias("time_of_day"), F.localtimestamp().isNotNull().alias("local"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%d/%m/%y %b %A') as named, strftime(o_orderdate, '%H:%M:%S at %I') as time from orders")
def to_char(spark, d):
    t = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", D.to_char(t, "YYYY-MM-DD").alias("iso"), D.to_char(t, "DD/MM/YY Mon Day").alias("named"), D.to_char(t, "HH24:MI:SS at HH12").alias("time"))


@query("select s, try_strptime(s, '%Y-%m-%d')::date as v from (values ('2024-02-29'), ('2023-02-29'), ('nonsense'), (null)) t(s)")
def to_date(spark, d):
    rows = spark.sql("select * from values ('2024-02-29'), ('2023-02-29'), ('nonsense'), (null) as t(s)")
    return rows.select("s", D.to_date(F.col("s"), "YYYY-MM-DD").alias("v"))


@query("select o_orderkey, o_orderdate::date as v from orders")
def to_date_round_trip(spark, d):
    return read(spark, d, "orders").select("o_orderkey", D.to_date(D.to_char(F.col("o_orderdate"), "DD.MM.YYYY"), "DD.MM.YYYY").alias("v"))


@query("select event_id, date_trunc('second', ts) as v from events")
def to_timestamp(spark, d):
    shape = "YYYY-MM-DD HH24:MI:SS"
    return read(spark, d, "events").select("event_id", D.to_timestamp(D.to_char(F.col("ts"), shape), shape).alias("v"))


_ROLL = "cast(cast(date_trunc('month', x) + to_months({m}) as date) + cast(day(x) - 1 + {n} as integer) as date)"


@query(f"select x, {_ROLL.format(m=1, n=0)} as month, {_ROLL.format(m=0, n=40)} as days, {_ROLL.format(m=14, n=3)} as both from (select unnest([date '2024-01-31', date '2023-01-31', date '2024-02-29', date '2024-12-15', null]) as x)")
def date_add(spark, d):
    rows = spark.sql("select explode(array(date'2024-01-31', date'2023-01-31', date'2024-02-29', date'2024-12-15', null)) as x")
    x = F.col("x")
    return rows.select("x", D.date_add(x, D.interval(months=1)).alias("month"), D.date_add(x, D.interval(days=40)).alias("days"), D.date_add(x, D.interval(14, 3)).alias("both"))


@query(f"select o_orderkey, {_ROLL.format(m=-5, n=-10).replace('x)', 'o_orderdate)')} as v from orders")
def date_sub(spark, d):
    return read(spark, d, "orders").select("o_orderkey", D.date_sub(F.to_date("o_orderdate"), D.interval(5, 10)).alias("v"))


@query("select l_orderkey, l_linenumber, cast(date_diff('day', o_orderdate::date, l_shipdate::date) as integer) as v from lineitem join orders on l_orderkey = o_orderkey")
def datediff(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", D.datediff(F.col("l_shipdate"), F.col("o_orderdate")).alias("v"))


@query("select event_id, cast(year(ts) as integer) as y, cast(month(ts) as integer) as mo, cast(day(ts) as integer) as dy, cast(hour(ts) as integer) as h, cast(minute(ts) as integer) as mi, cast(second(ts) as integer) as s from events")
def date_fields(spark, d):
    fields = {"y": F.year, "mo": F.month, "dy": F.day, "h": F.hour, "mi": F.minute, "s": F.second}
    return read(spark, d, "events").select("event_id", *(f("ts").alias(k) for k, f in fields.items()))


_TRUNC = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@query(f"select event_id, {', '.join(f'cast(date_trunc({f!r}, ts) as timestamp) as to_{f}' for f in _TRUNC)} from events")
def date_trunc(spark, d):
    return read(spark, d, "events").select("event_id", *(D.date_trunc(f, F.col("ts")).cast("timestamp_ntz").alias(f"to_{f}") for f in _TRUNC))


_PARTS = {"year": "year", "quarter": "quarter", "month": "month", "week": "week", "day": "day", "dow": "dow", "doy": "doy", "hour": "hour", "minute": "minute", "microsecond": "microsecond", "epoch": "epoch"}


@query(f"select event_id, {', '.join(f'round(cast(date_part({f!r}, ts) as double), 3) as p_{f}' for f in _PARTS)}, round(date_part('microsecond', ts) / 1e6, 3) as p_second, round(date_part('microsecond', ts) / 1e3, 3) as p_millisecond from events")
def extract(spark, d):
    return read(spark, d, "events").select("event_id", *(F.round(D.extract(f, F.col("ts")), 3).alias(f"p_{f}") for f in [*_PARTS, "second", "millisecond"]))


@query("select o_orderkey, cast(date_part('isoyear', o_orderdate) as bigint) as y, cast(date_part('quarter', o_orderdate) as double) as q from orders")
def date_part(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.date_part(F.lit("YEAROFWEEK"), "o_orderdate").cast("bigint").alias("y"), D.extract("quarter", F.col("o_orderdate")).alias("q"))


@query("""with t as (select o_orderkey, greatest(o_orderdate, e) as late, least(o_orderdate, e) as early, case when e < o_orderdate then -1 else 1 end as sign from orders, (select timestamp '1996-03-15 12:30:00' as e)),
b as (select *, case when day(late) < day(early) then 1 else 0 end as borrowed from t)
select o_orderkey, cast(sign * ((year(late) - year(early)) * 12 + month(late) - month(early) - borrowed) as bigint) as months,
cast(sign * ((day(late) - day(early) + borrowed * day(cast(date_trunc('month', late) as date) - 1)) * 86400000000 + (epoch_us(late) - epoch_us(date_trunc('day', late)::timestamp)) - (epoch_us(early) - epoch_us(date_trunc('day', early)::timestamp))) as bigint) as micros from b""")
def age(spark, d):
    out = D.age(F.lit("1996-03-15 12:30:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", out["months"].alias("months"), out["micros"].alias("micros"))


@query("select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as v, coalesce(case when c_acctbal < 0 then null else c_acctbal end, 0.0) as w from customer")
def coalesce(spark, d):
    return read(spark, d, "customer").select("c_custkey", C.coalesce(C.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("v"), C.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(0.0)).alias("w"))


@query("select x, case when coalesce(x <> 0, false) then 'yes' else 'no' end as n, case when coalesce(s <> '', false) then 'yes' else 'no' end as t, case when coalesce(x > 1, false) then 'yes' else 'no' end as b from (values (0, ''), (2, 'a'), (null, null)) t(x, s)")
def if_fn(spark, d):
    rows = spark.sql("select * from values (0, ''), (2, 'a'), (null, null) as t(x, s)")
    yes, no = F.lit("yes"), F.lit("no")
    return rows.select("x", C.if_(F.col("x"), yes, no, "int").alias("n"), C.if_(F.col("s"), yes, no, "string").alias("t"), C.if_(F.col("x") > 1, yes, no).alias("b"))


@query("select x, coalesce(x, -1) as v from (values (1), (null)) t(x)")
def ifnull(spark, d):
    return spark.sql("select * from values (1), (null) as t(x)").select("x", C.ifnull(F.col("x"), F.lit(-1)).alias("v"))


@query("select p_partkey, nullif(p_size, 10) as v from part")
def nullif(spark, d):
    return read(spark, d, "part").select("p_partkey", C.nullif(F.col("p_size"), F.lit(10)).alias("v"))

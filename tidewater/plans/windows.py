"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators.windows import row_number, rows, running, spec
from tidewater.plans.registry import query
from tidewater.sources.tables import read

_OVER = "partition by o_custkey order by o_orderdate, o_orderkey"
_KEY, _ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]


@query(f"select o_orderkey, row_number() over ({_OVER}) as n from orders")
def win_row_number(spark, d):
    return read(spark, d, "orders").select("o_orderkey", row_number(_KEY, _ORDER).cast("bigint").alias("n"))


@query("select p_partkey, rank() over (partition by p_brand order by p_size) as r from part")
def win_rank(spark, d):
    return read(spark, d, "part").select("p_partkey", F.rank().over(spec(["p_brand"], ["p_size"])).cast("bigint").alias("r"))


@query("select p_partkey, dense_rank() over (partition by p_brand order by p_size desc) as r from part")
def win_dense_rank(spark, d):
    return read(spark, d, "part").select("p_partkey", F.dense_rank().over(spec(["p_brand"], [F.desc("p_size")])).cast("bigint").alias("r"))


@query("select event_id, lag(value) over w as before, lag(value, 2, -1.0) over w as two_before from events window w as (partition by user_id order by ts, event_id)")
def win_lag(spark, d):
    w = spec(["user_id"], ["ts", "event_id"])
    return read(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lag("value", 2, -1.0).over(w).alias("two_before"))


@query("select event_id, lead(event_type) over w as next, lead(value, 3, 0.0) over w as third from events window w as (partition by user_id order by ts, event_id)")
def win_lead(spark, d):
    w = spec(["user_id"], ["ts", "event_id"])
    return read(spark, d, "events").select("event_id", F.lead("event_type").over(w).alias("next"), F.lead("value", 3, 0.0).over(w).alias("third"))


@query("""select l_orderkey, l_linenumber, round(sum(l_quantity) over w, 2) as total, round(avg(l_quantity) over w, 6) as mean, count(*) over w as n, min(l_quantity) over w as low, max(l_quantity) over w as high
from lineitem window w as (partition by l_orderkey)""")
def win_agg(spark, d):
    q, key = F.col("l_quantity"), ["l_orderkey"]
    aggs = {"total": F.round(running(F.sum(q), key), 2), "mean": F.round(running(F.avg(q), key), 6), "n": running(F.count(F.lit(1)), key), "low": running(F.min(q), key), "high": running(F.max(q), key)}
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in aggs.items()))


_FRAMES = {
    "up_to_here": ("unbounded preceding", "current row", None, 0),
    "last_three": ("2 preceding", "current row", -2, 0),
    "around": ("1 preceding", "1 following", -1, 1),
    "from_here": ("current row", "unbounded following", 0, None),
    "all_rows": ("unbounded preceding", "unbounded following", None, None),
}


@query(f"select o_orderkey, {', '.join(f'round(sum(o_totalprice) over ({_OVER} rows between {a} and {b}), 2) as {k}' for k, (a, b, _, _) in _FRAMES.items())} from orders")
def win_frame(spark, d):
    frames = {k: F.round(F.sum("o_totalprice").over(rows(_KEY, _ORDER, a, b)), 2) for k, (_, _, a, b) in _FRAMES.items()}
    return read(spark, d, "orders").select("o_orderkey", *(c.alias(k) for k, c in frames.items()))


@query(f"select o_orderkey, {', '.join(f'{f}(o_totalprice) over ({_OVER} rows between 3 preceding and 1 preceding) as {f}_before' for f in ('min', 'max', 'count'))}, round(avg(o_totalprice) over ({_OVER} rows between 3 preceding and 1 preceding), 4) as avg_before from orders")
def win_frame_agg(spark, d):
    w, price = rows(_KEY, _ORDER, -3, -1), F.col("o_totalprice")
    aggs = {"min_before": F.min(price).over(w), "max_before": F.max(price).over(w), "count_before": F.count(price).over(w), "avg_before": F.round(F.avg(price).over(w), 4)}
    return read(spark, d, "orders").select("o_orderkey", *(c.alias(k) for k, c in aggs.items()))


@query("select p_partkey, sum(p_size) over (partition by p_brand order by p_type rows between unbounded preceding and unbounded following)::bigint as whole, count(*) over (partition by p_brand order by p_size) as peers from part")
def win_range_peers(spark, d):
    return read(spark, d, "part").select("p_partkey", F.sum("p_size").over(rows(["p_brand"], ["p_type"], None, None)).alias("whole"), F.count(F.lit(1)).over(spec(["p_brand"], ["p_size"])).alias("peers"))


@query(f"select o_orderkey, round(sum(o_totalprice) over ({_OVER} rows unbounded preceding), 2) as so_far from orders")
def win_default_frame(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(running(F.sum("o_totalprice"), _KEY, _ORDER), 2).alias("so_far"))


@query("select c_custkey, c_nationkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as n from customer) where n <= 3")
def win_top_per_group(spark, d):
    ranked = read(spark, d, "customer").withColumn("n", row_number(["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]))
    return ranked.filter("n <= 3").select("c_custkey", "c_nationkey", "c_acctbal")


@query("select conv_id, turn, role, row_number() over w as n, lag(role) over w as before from conversations window w as (partition by conv_id order by turn)")
def win_conversations(spark, d):
    w = spec(["conv_id"], ["turn"])
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("bigint").alias("n"), F.lag("role").over(w).alias("before"))

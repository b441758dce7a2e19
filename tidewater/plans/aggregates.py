"""Grouping and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators.aggregates import SumOfSquares, udaf
from tidewater.plans.registry import query
from tidewater.sources.tables import read, register


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def agg_hash(spark, d):
    price, off = F.col("l_extendedprice"), 1 - F.col("l_discount")
    out = read(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return out.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * off), 2).alias("sum_disc"), F.round(F.sum(price * off * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("select year(o_orderdate) as y, o_totalprice > 150000 as big, count(*) as n from orders group by year(o_orderdate), o_totalprice > 150000")
def agg_key(spark, d):
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_totalprice") > 150000).alias("big")).agg(F.count(F.lit(1)).alias("n"))


@query("select k, count(*) as n, sum(v)::bigint as s from (values (1, 10), (null, 20), (null, 30), (1, null)) t(k, v) group by k")
def agg_null_key(spark, d):
    return spark.sql("select k, count(*) as n, sum(v) as s from values (1, 10), (null, 20), (null, 30), (1, null) as t(k, v) group by k")


@query("select count(*) as n, count(p_size) as sizes, sum(p_size)::bigint as total, round(avg(p_size), 6) as mean, min(p_name) as first, max(p_retailprice) as dearest from part")
def agg_global(spark, d):
    return read(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count("p_size").alias("sizes"), F.sum("p_size").alias("total"), F.round(F.avg("p_size"), 6).alias("mean"), F.min("p_name").alias("first"), F.max("p_retailprice").alias("dearest"))


@query("select count(*) as n, count(p_size) as sizes, sum(p_size)::bigint as total, avg(p_size) as mean, min(p_name) as first from part where p_size < 0")
def agg_global_empty(spark, d):
    return read(spark, d, "part").filter("p_size < 0").agg(F.count(F.lit(1)).alias("n"), F.count("p_size").alias("sizes"), F.sum("p_size").alias("total"), F.avg("p_size").alias("mean"), F.min("p_name").alias("first"))


@query("select event_type, count(*) as n from events group by event_type")
def agg_count_star(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by c_mktsegment")
def agg_count(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"))


@query("select l_suppkey, round(sum(l_extendedprice), 2) as total, sum(l_linenumber)::bigint as lines from lineitem group by l_suppkey")
def agg_sum(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.sum("l_linenumber").alias("lines"))


@query("select p_brand, round(avg(p_retailprice), 4) as mean, round(avg(p_size), 6) as mean_size from part group by p_brand")
def agg_avg(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@query("select o_orderpriority, min(o_orderdate) as first, min(o_totalprice) as least, min(o_orderstatus) as status from orders group by o_orderpriority")
def agg_min(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("first"), F.min("o_totalprice").alias("least"), F.min("o_orderstatus").alias("status"))


@query("select o_orderpriority, max(o_orderdate) as last, max(o_totalprice) as most, max(o_orderstatus) as status from orders group by o_orderpriority")
def agg_max(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("last"), F.max("o_totalprice").alias("most"), F.max("o_orderstatus").alias("status"))


@query("select label, round(sum(label * label * 1.0), 6)::double as squares from (select label from embeddings where label is not null) group by label")
def udaf_sum_of_squares(spark, d):
    return udaf(read(spark, d, "embeddings").filter("label is not null"), ["label"], "label", SumOfSquares(), "squares")


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey having count(*) > 10 and sum(o_totalprice) > 1500000")
def having(spark, d):
    out = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return out.filter("n > 10 and total > 1500000").withColumn("total", F.round("total", 2))


@query("select p_brand, sum(p_size)::bigint + 1 as plus_one, round(max(p_retailprice) - min(p_retailprice), 2) as spread from part group by p_brand order by spread desc, p_brand")
def agg_extract(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg((F.sum("p_size") + 1).alias("plus_one"), F.round(F.max("p_retailprice") - F.min("p_retailprice"), 2).alias("spread")).orderBy(F.desc("spread"), "p_brand")


@query("select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag")
def agg_distinct(spark, d):
    register(spark, d, ["lineitem"])
    return spark.sql("select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag")

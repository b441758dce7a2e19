"""Statistics, integrity checks, and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import changes as X
from tidewater.operators import statistics as T
from tidewater.plans.registry import query
from tidewater.sources.tables import read

_COLS = ("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")


@query(" union all ".join(f"select '{c}' as \"column\", count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\" from lineitem" for c in _COLS))
def stat_analyze(spark, d):
    return T.exact_statistics(read(spark, d, "lineitem"), *_COLS)


@query("""select 'p_name' as "column", count(*) as n, 0::bigint as nulls, true as near, round(avg(length(p_name)), 6) as width, min(p_name) as low, max(p_name) as high from part
union all select 'p_size', count(*), 0, true, round(avg(length(p_size::varchar)), 6), min(p_size)::varchar, max(p_size)::varchar from part""")
def stat_cols(spark, d):
    part = read(spark, d, "part").select("p_name", "p_size")
    exact = T.exact_statistics(part, "p_name", "p_size").select(F.col("column").alias("c"), F.col("distinct").alias("e"))
    out = T.column_statistics(part).join(exact, F.col("column") == F.col("c"))
    return out.select("column", "n", "nulls", (F.abs(F.col("distinct") - F.col("e")) <= 0.05 * F.col("e") + 1).alias("near"), F.round("width", 6).alias("width"), "low", "high")


@query("select cast(100 as bigint) as n, cast(100 as bigint) as different, true as known")
def stat_sample(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    s = T.sample(o, 100)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("different"), F.min(F.col("o_orderkey") >= 0).alias("known"))


@query("select cast(4 as bigint) as buckets, count(*) as n, true as even from orders")
def stat_hist(spark, d):
    h = T.histogram(read(spark, d, "orders"), "o_totalprice", 4)
    return h.agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 0.02 * F.sum("n") + 2).alias("even"))


@query("select round(1.0 / count(distinct o_custkey), 9)::double as v from orders")
def stat_eqsel(spark, d):
    return T.exact_statistics(read(spark, d, "orders"), "o_custkey").select(F.round(T.equality_selectivity(F.col("distinct")), 9).alias("v"))


@query("select round((count(*) - count(o_orderkey)) / count(*), 9)::double as v from customer left join orders on c_custkey = o_custkey")
def stat_nullfrac(spark, d):
    both = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return T.exact_statistics(both, "o_orderkey").select(F.round(T.null_fraction(F.col("nulls"), F.col("n")), 9).alias("v"))


@query("select true as pushed, true as pruned")
def explain(spark, d):
    """What the plan of a point query says: the filter reaches the scan, and only its columns are read."""
    df = read(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_totalprice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return spark.range(1).select(F.lit("EqualTo(o_orderkey,7)" in plan).alias("pushed"), F.lit("o_orderpriority" not in plan).alias("pruned"))


@query("select count(*) as orphans from orders where o_custkey not in (select c_custkey from customer)")
def chk_fk(spark, d):
    return X.violations_foreign_key(read(spark, d, "orders"), read(spark, d, "customer"), {"o_custkey": "c_custkey"}).agg(F.count(F.lit(1)).alias("orphans"))


@query("select 'orders' as tbl, cast(0 as bigint) as repeated, cast(0 as bigint) as orphans union all select 'nation', 0, 0")
def chk_integrity(spark, d):
    def of(table, key, parent, ref, to):
        t = read(spark, d, table)
        repeated = X.violations_unique(t, [key]).agg(F.count(F.lit(1)).alias("repeated"))
        orphans = X.violations_foreign_key(t, read(spark, d, parent), {ref: to}).agg(F.count(F.lit(1)).alias("orphans"))
        return repeated.join(orphans, F.lit(True)).select(F.lit(table).alias("tbl"), "repeated", "orphans")  # one row each

    return of("orders", "o_orderkey", "customer", "o_custkey", "c_custkey").union(of("nation", "n_nationkey", "region", "n_regionkey", "r_regionkey"))

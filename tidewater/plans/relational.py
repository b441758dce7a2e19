"""Scans, projections, predicates, joins, sorting, set operations, and queries within queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import relational as R
from tidewater.plans.registry import query
from tidewater.sources.tables import read, register


@query("""select c_mktsegment, n_name, count(*) as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey join nation on c_nationkey = n_nationkey
where l_shipdate >= timestamp '1995-01-01' group by c_mktsegment, n_name order by revenue desc, c_mktsegment, n_name limit 20""")
def flagship_revenue(spark, d):
    sales = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sales = sales.filter("l_shipdate >= timestamp_ntz '1995-01-01'").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = sales.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "c_mktsegment", "n_name").limit(20)


@query("select * from part")
def scan_table(spark, d):
    return read(spark, d, "part")


@query("select o_orderkey, o_totalprice from orders")
def scan_all_columns_pruned(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("select * from orders where o_orderkey = 7")
def scan_pk(spark, d):
    return R.point(read(spark, d, "orders"), "o_orderkey", 7)


@query("select * from customer where c_custkey = 42")
def scan_pk_direct(spark, d):
    return R.point(read(spark, d, "customer"), "c_custkey", 42)


@query("with big as (select * from orders where o_totalprice > 200000) select o_orderstatus, count(*) as n from big group by o_orderstatus")
def scan_cte(spark, d):
    register(spark, d, ["orders"])
    return spark.sql("with big as (select * from orders where o_totalprice > 200000) select o_orderstatus, count(*) as n from big group by o_orderstatus")


@query("select cast(1 + 2 * 3 as integer) as seven, 'a' || 'b' as ab")
def scan_dual(spark, d):
    return spark.sql("select 1 + 2 * 3 as seven, 'a' || 'b' as ab")


@query("select s.k, s.total from (select o_custkey as k, round(sum(o_totalprice), 2) as total from orders group by o_custkey) s where s.total > 500000")
def scan_subquery(spark, d):
    totals = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).alias("s")
    return totals.filter(F.col("s.total") > 500000).select("s.k", "s.total")


@query("select * from (values (1, 'one'), (2, 'two'), (3, null)) t(n, word)")
def scan_values(spark, d):
    return spark.sql("select * from values (1, 'one'), (2, 'two'), (3, null) as t(n, word)")


@query("select c_custkey, c_name from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'", name="filter")
def filter_(spark, d):
    return read(spark, d, "customer").filter("c_acctbal > 5000 and c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge from lineitem")
def project(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("charge"))


@query("select * from nation")
def project_star(spark, d):
    return read(spark, d, "nation").select("*")


@query("select s_suppkey as id, s_name as supplier_name from supplier")
def alias_col(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("supplier_name"))


@query("""select p_partkey, p_size + 1 as plus, p_size - 7 as minus, p_size * 3 as times, p_size // 4 as quarter, p_size // nullif(p_size - p_size, 0) as by_zero,
round(p_retailprice / 3, 6) as third, p_retailprice / nullif(cast(0 as double), 0) as over_zero, -p_size as negated from part""")
def op_arith(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", (size + 1).alias("plus"), (size - 7).alias("minus"), (size * 3).alias("times"), R.divide(size, F.lit(4), whole=True).cast("int").alias("quarter"), R.divide(size, size - size, whole=True).cast("int").alias("by_zero"), F.round(R.divide(price, F.lit(3.0)), 6).alias("third"), R.divide(price, F.lit(0.0)).alias("over_zero"), (-size).alias("negated"))


@query("select s_suppkey, -s_acctbal as owed from supplier where not (s_acctbal < 0)")
def op_neg(spark, d):
    return read(spark, d, "supplier").filter(~(F.col("s_acctbal") < 0)).select("s_suppkey", (-F.col("s_acctbal")).alias("owed"))


@query("""select x, y, cast(x = y as integer) as eq, cast(x <> y as integer) as ne, cast(x < y as integer) as lt, cast(x <= y as integer) as le, cast(x > y as integer) as gt, cast(x >= y as integer) as ge,
cast(x is not distinct from y as integer) as same from (values (1, 1), (1, 2), (2, 1), (null, 1), (null, null)) t(x, y)""")
def op_cmp(spark, d):
    x, y = F.col("x"), F.col("y")
    rows = spark.sql("select * from values (1, 1), (1, 2), (2, 1), (null, 1), (null, null) as t(x, y)")
    pairs = {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y, "same": x.eqNullSafe(y)}
    return rows.select("x", "y", *(c.cast("int").alias(k) for k, c in pairs.items()))


@query("select p_partkey from part where (p_size < 10 or p_brand = 'Brand#13') and not p_type like 'ECONOMY%'")
def op_logic(spark, d):
    return read(spark, d, "part").filter(((F.col("p_size") < 10) | (F.col("p_brand") == "Brand#13")) & ~F.col("p_type").like("ECONOMY%")).select("p_partkey")


@query("select p_partkey, p_size from part where p_size in (1, 5, 9) or p_brand not in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')")
def pred_in_list(spark, d):
    return read(spark, d, "part").filter(F.col("p_size").isin(1, 5, 9) | ~F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")).select("p_partkey", "p_size")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def pred_in_sub(spark, d):
    big = read(spark, d, "orders").filter("o_totalprice > 300000")
    return R.semi(read(spark, d, "customer"), big, {"c_custkey": "o_custkey"}).select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def pred_not_in_sub(spark, d):
    return R.anti(read(spark, d, "customer"), read(spark, d, "orders"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("select x from (values (1), (2), (null)) t(x) where x not in (select y from (values (2), (null)) u(y))")
def pred_not_in_null(spark, d):
    return spark.sql("select x from values (1), (2), (null) as t(x) where x not in (select y from values (2), (null) as u(y))")


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 250000)")
def pred_exists(spark, d):
    return R.semi(read(spark, d, "customer"), read(spark, d, "orders").filter("o_totalprice > 250000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("select s_suppkey from supplier s where not exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey and l.l_quantity >= 50)")
def pred_not_exists(spark, d):
    return R.anti(read(spark, d, "supplier"), read(spark, d, "lineitem").filter("l_quantity >= 50"), {"s_suppkey": "l_suppkey"}).select("s_suppkey")


@query("""select o_orderkey, o_totalprice from orders o where o_totalprice > (select 2 * avg(o_totalprice) from orders i where i.o_orderpriority = o.o_orderpriority)""")
def sub_correlate(spark, d):
    register(spark, d, ["orders"])
    return spark.sql("select o_orderkey, o_totalprice from orders o where o_totalprice > (select 2 * avg(o_totalprice) from orders i where i.o_orderpriority = o.o_orderpriority)")


@query("select o_orderkey, o_totalprice from orders where o_totalprice = (select max(o_totalprice) from orders)")
def sub_scalar(spark, d):
    register(spark, d, ["orders"])
    return spark.sql("select o_orderkey, o_totalprice from orders where o_totalprice = (select max(o_totalprice) from orders)")


@query("select x, (select y from (values (1)) u(y) where y > 5) as none from (values (1), (2)) t(x)")
def sub_scalar_empty(spark, d):
    return spark.sql("select x, (select y from values (1) as u(y) where y > 5) as none from values (1), (2) as t(x)")


@query("select p_partkey, p_name from part where p_name ilike '%GREEN%' or p_type ilike '_TANDARD%' or p_name not ilike '%e%'")
def pred_like(spark, d):
    return read(spark, d, "part").filter(R.like("p_name", "%GREEN%") | R.like("p_type", "_TANDARD%") | ~R.like("p_name", "%e%")).select("p_partkey", "p_name")


@query("select o_orderkey, case when o_totalprice > 200000 then 'large' when o_totalprice > 100000 then 'medium' else 'small' end as size_class, case when o_totalprice > 400000 then 1 end as huge from orders")
def case_searched(spark, d):
    price = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.when(price > 200000, "large").when(price > 100000, "medium").otherwise("small").alias("size_class"), F.when(price > 400000, 1).alias("huge"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end as status from orders")
def case_simple(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R.case("o_orderstatus", {"F": "finished", "O": "open"}, "other").alias("status"))


@query("select c_custkey, c_name from customer where c_nationkey = 7 and c_acctbal > 1000")
def param(spark, d):
    register(spark, d, ["customer"])
    return spark.sql("select c_custkey, c_name from customer where c_nationkey = ? and c_acctbal > ?", args=[7, 1000])


@query("select cast(42 as integer) as i, cast(2.5 as double) as f, 'it''s' as s, true as t, cast(null as integer) as n, lower(hex('\\x00\\xFF'::blob)) as b")
def lit(spark, d):
    return spark.sql("select 42 as i, 2.5D as f, 'it''s' as s, true as t, cast(null as int) as n, lower(hex(x'00FF')) as b")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_inner(spark, d):
    return R.join(read(spark, d, "nation"), read(spark, d, "region"), {"n_regionkey": "r_regionkey"}).select("n_name", "r_name")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000")
def join_left(spark, d):
    return R.join(read(spark, d, "customer"), read(spark, d, "orders").filter("o_totalprice > 200000"), {"c_custkey": "o_custkey"}, "left").select("c_custkey", "o_orderkey")


@query("select o_orderkey, c_custkey, c_name from orders right join customer on o_custkey = c_custkey and o_totalprice > 300000")
def join_right(spark, d):
    return R.join(read(spark, d, "orders").filter("o_totalprice > 300000"), read(spark, d, "customer"), {"o_custkey": "c_custkey"}, "right").select("o_orderkey", "c_custkey", "c_name")


@query("select s_suppkey, c_custkey from (select * from supplier where s_acctbal > 8000) s full join (select * from customer where c_acctbal > 9000) c on s_nationkey = c_nationkey")
def join_full(spark, d):
    return R.join(read(spark, d, "supplier").filter("s_acctbal > 8000"), read(spark, d, "customer").filter("c_acctbal > 9000"), {"s_nationkey": "c_nationkey"}, "full").select("s_suppkey", "c_custkey")


@query("select a.n_name as low, b.n_name as high from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
def join_theta(spark, d):
    a, b = read(spark, d, "nation").alias("a"), read(spark, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


@query("select r.r_name as region, n.n_name as nation from region r join nation n on n.n_name like '%' || substr(r.r_name, 1, 2) || '%' or n.n_regionkey > r.r_regionkey + 2")
def join_theta_or(spark, d):
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    on = F.expr("n_name like '%' || substr(r_name, 1, 2) || '%' or n_regionkey > r_regionkey + 2")
    return n.join(F.broadcast(r), on).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


@query("""select r_name, count(*) as n, round(sum(o_totalprice), 2) as total from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey group by r_name""")
def join_multi(spark, d):
    out = R.join(read(spark, d, "orders"), read(spark, d, "customer"), {"o_custkey": "c_custkey"})
    out = R.join(R.join(out, read(spark, d, "nation"), {"c_nationkey": "n_nationkey"}), read(spark, d, "region"), {"n_regionkey": "r_regionkey"})
    return out.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def join_self(spark, d):
    a, b = read(spark, d, "supplier").alias("a"), read(spark, d, "supplier").alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a_key"), F.col("b.s_suppkey").alias("b_key"))


@query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'P'")
def join_hash(spark, d):
    return R.join(read(spark, d, "lineitem"), read(spark, d, "orders").filter("o_orderstatus = 'P'"), {"l_orderkey": "o_orderkey"}, hint="shuffle_hash").select("o_orderkey", "l_linenumber", "l_quantity")


@query("select a.x as x, b.y as y from (values (1, 'a'), (null, 'b')) a(k, x) join (values (1, 'c'), (null, 'd')) b(k, y) on a.k is not distinct from b.k")
def join_null_safe(spark, d):
    a, b = spark.sql("select * from values (1, 'a'), (null, 'b') as a(k, x)"), spark.sql("select * from values (1, 'c'), (null, 'd') as b(j, y)")
    return R.join(a, b, {"k": "j"}, null_safe=True).select("x", "y")


@query("select * from customer c semi join orders o on c.c_custkey = o.o_custkey")
def join_semi(spark, d):
    return R.semi(read(spark, d, "customer"), read(spark, d, "orders"), {"c_custkey": "o_custkey"})


@query("select * from customer c anti join orders o on c.c_custkey = o.o_custkey")
def join_anti(spark, d):
    return R.anti(read(spark, d, "customer"), read(spark, d, "orders"), {"c_custkey": "o_custkey"})


@query("select o_custkey, o_orderdate, o_orderkey from orders order by o_custkey asc nulls first, o_orderdate desc nulls last, o_orderkey")
def sort(spark, d):
    return read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", F.desc("o_orderdate"), "o_orderkey")


@query("select x, row_number() over (order by x asc nulls first) as up, row_number() over (order by x desc nulls last) as down from (values (3), (null), (1), (2)) t(x)")
def sort_nulls(spark, d):
    return spark.sql("select x, cast(row_number() over (order by x) as bigint) as up, cast(row_number() over (order by x desc) as bigint) as down from values (3), (null), (1), (2) as t(x)")


@query("select o_orderkey from orders order by o_orderkey limit 10", name="limit")
def limit_(spark, d):
    return read(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(10)


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 25")
def offset(spark, d):
    return read(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(25).limit(10)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def topk(spark, d):
    return R.top(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 15, F.desc("o_totalprice"), "o_orderkey")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def set_union_all(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier")
def set_intersect(spark, d):
    return read(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def set_intersect_all(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(read(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 5000")
def set_except(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(read(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def set_except_all(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(spark, d, "supplier").select("s_nationkey"))


@query("with k as (select c_nationkey as k from customer where c_acctbal < 0 union select s_nationkey from supplier where s_acctbal < 0) select k, n_name from k join nation on k = n_nationkey")
def set_cte(spark, d):
    register(spark, d, ["customer", "supplier", "nation"])
    return spark.sql("with k as (select c_nationkey as k from customer where c_acctbal < 0 union select s_nationkey from supplier where s_acctbal < 0) select k, n_name from k join nation on k = n_nationkey")


@query("""with a(k, n) as (select o_custkey, count(*) from orders group by o_custkey), b as (select k from a where n > 15) select c_custkey, c_name from customer join b on c_custkey = k""")
def cte(spark, d):
    register(spark, d, ["orders", "customer"])
    return spark.sql("with a(k, n) as (select o_custkey, count(*) from orders group by o_custkey), b as (select k from a where n > 15) select c_custkey, c_name from customer join b on c_custkey = k")


@query("with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from t where n < 20) select n, f from t")
def cte_rec(spark, d):
    return spark.sql("with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from t where n < 20) select n, f from t")


@query("with recursive m as (select date '2024-01-01' as first union all select cast(first + interval 1 month as date) from m where first < date '2024-12-01') select first, day(last_day(first)) as days from m")
def cte_rec_calendar(spark, d):
    return spark.sql("with recursive m as (select date'2024-01-01' as first union all select add_months(first, 1) from m where first < date'2024-12-01') select first, cast(day(last_day(first)) as bigint) as days from m")


@query("select c_custkey, c_acctbal from customer where c_acctbal > 9000 and c_mktsegment = 'MACHINERY'")
def view_create(spark, d):
    register(spark, d, ["customer"])
    spark.sql("create or replace temporary view rich as select * from customer where c_acctbal > 9000")
    return spark.sql("select c_custkey, c_acctbal from rich where c_mktsegment = 'MACHINERY'")


@query("select cast(0 as bigint) as n")
def view_drop(spark, d):
    read(spark, d, "nation").createOrReplaceTempView("to_drop")
    spark.catalog.dropTempView("to_drop")
    return spark.range(1).select(F.lit(int(spark.catalog.tableExists("to_drop"))).cast("bigint").alias("n"))


@query("select d.o_orderpriority, d.n from (select o_orderpriority, count(*) as n from orders group by o_orderpriority) as d where d.n > 10")
def derived(spark, d):
    register(spark, d, ["orders"])
    return spark.sql("select d.o_orderpriority, d.n from (select o_orderpriority, count(*) as n from orders group by o_orderpriority) as d where d.n > 10")

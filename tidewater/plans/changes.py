"""Changes to tables, constraints, and row versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import changes as X
from tidewater.operators import versions
from tidewater.plans.registry import query
from tidewater.sources.tables import coerce, read

_C = "c_custkey, c_nationkey, c_acctbal"


def _customers(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


@query(f"select {_C} from customer union all select 900001, 3, 5.5 union all select 900002, null, null")
def dml_insert(spark, d):
    return X.insert(_customers(spark, d), spark.sql("select * from values (900001, 3, 5.5), (900002, null, null) as t(c_custkey, c_nationkey, c_acctbal)"))


@query("select c_custkey, c_nationkey, c_acctbal from customer union all select c_custkey + 500000, 7, 0.0 from customer where c_acctbal < 0")
def dml_insert_select(spark, d):
    rows = _customers(spark, d).filter("c_acctbal < 0").select((F.col("c_custkey") + 500000).alias("c_custkey"), F.lit(7).alias("c_nationkey"))
    return X.insert(_customers(spark, d), rows, {"c_acctbal": F.lit(0.0)})


@query("""select coalesce(c.c_custkey, n.k) as c_custkey, case when c.c_custkey is null then 1 else c.c_nationkey end as c_nationkey, case when c.c_custkey is null then n.b when n.k is null then c.c_acctbal else c.c_acctbal + n.b end as c_acctbal
from customer c full join (select c_custkey * 100 as k, 10.0::double as b from customer) n on c.c_custkey = n.k""")
def dml_upsert(spark, d):
    new = _customers(spark, d).select((F.col("c_custkey") * 100).alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit(10.0).alias("c_acctbal"))
    return X.upsert(_customers(spark, d), new, ["c_custkey"], {"c_acctbal": F.col("old.c_acctbal") + F.col("new.c_acctbal")})


@query("select c_custkey from customer where c_custkey in (select c_custkey * 100 from customer)")
def dml_upsert_find(spark, d):
    new = _customers(spark, d).select((F.col("c_custkey") * 100).alias("k"))
    return _customers(spark, d).join(new, F.col("c_custkey") == F.col("k"), "left_semi").select("c_custkey")


@query("select c_custkey, case when c_acctbal < 0 then cast(c_custkey % 25 as integer) else c_nationkey end as c_nationkey, case when c_acctbal < 0 then -c_acctbal else c_acctbal end as c_acctbal from customer")
def dml_update(spark, d):
    return X.update(_customers(spark, d), {"c_acctbal": -F.col("c_acctbal"), "c_nationkey": F.col("c_custkey") % 25}, F.col("c_acctbal") < 0)


@query(f"select {_C} from customer where not (c_nationkey = 3 and c_acctbal > 0)")
def dml_delete(spark, d):
    return X.delete(_customers(spark, d), (F.col("c_nationkey") == 3) & (F.col("c_acctbal") > 0))


@query("select cast(0 as bigint) as n")
def dml_truncate(spark, d):
    return X.truncate(_customers(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(max(c_custkey) + 1 as bigint) as first, cast(max(c_custkey) + count(*) as bigint) as last, count(*) as n from customer")
def con_autoinc(spark, d):
    rows = _customers(spark, d).withColumn("c_custkey", F.lit(None).cast("bigint"))
    out = X.number(_customers(spark, d), rows, "c_custkey", ["c_acctbal"])
    return out.agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"), F.countDistinct("c_custkey").alias("n"))


@query("select x from (values (1, null), (2, 'a'), (null, 'b')) t(x, y) where x is null or y is null")
def con_not_null(spark, d):
    return X.violations_not_null(spark.sql("select * from values (1, null), (2, 'a'), (null, 'b') as t(x, y)"), ["x", "y"]).select("x")


@query("select l_orderkey, l_linenumber from lineitem where not (l_quantity <= 49 and l_discount <= 0.09)")
def con_check(spark, d):
    return X.violations_check(read(spark, d, "lineitem"), (F.col("l_quantity") <= 49) & (F.col("l_discount") <= 0.09)).select("l_orderkey", "l_linenumber")


@query("select x, y from (values (5, 3), (1, 2), (null, 1)) t(x, y) where not coalesce(y >= x, true)")
def con_check_null(spark, d):
    return X.violations_check(spark.sql("select * from values (5, 3), (1, 2), (null, 1) as t(x, y)"), F.col("y") >= F.col("x"))


@query("select c_nationkey, c_mktsegment, count(*) as n from customer group by c_nationkey, c_mktsegment having count(*) > 1")
def con_unique(spark, d):
    return X.violations_unique(read(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("select c_nationkey, count(*) as n from customer where c_acctbal > 9500 group by c_nationkey having count(*) > 1")
def con_partial(spark, d):
    return X.violations_unique(read(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal") > 9500)


@query("select lower(substr(p_name, 1, 6)) as k, count(*) as n from part group by lower(substr(p_name, 1, 6)) having count(*) > 1")
def con_exprindex(spark, d):
    return X.violations_unique(read(spark, d, "part").select(F.lower(F.substring("p_name", 1, 6)).alias("k")), ["k"])


@query("select k, v from (values (1, 7), (2, null), (3, 99)) t(k, v) where v is not null and v not in (select n_nationkey from nation)")
def con_fk_value(spark, d):
    child = spark.sql("select * from values (1, 7), (2, null), (3, 99) as t(k, v)")
    return X.violations_foreign_key(child, read(spark, d, "nation"), {"v": "n_nationkey"})


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def con_fk_delete_cascade(spark, d):
    return X.delete_parents(_customers(spark, d), read(spark, d, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": "c_custkey"}, F.col("c_acctbal") < 0, "cascade")[1]


@query("select o_orderkey, case when o_custkey not in (select c_custkey from customer where c_acctbal < 0) then o_custkey end as o_custkey from orders")
def con_fk_delete_set_null(spark, d):
    return X.delete_parents(_customers(spark, d), read(spark, d, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": "c_custkey"}, F.col("c_acctbal") < 0, "set null")[1]


@query("select true as refused")
def con_fk_delete_restrict(spark, d):
    try:
        X.delete_parents(_customers(spark, d), read(spark, d, "orders"), {"o_custkey": "c_custkey"}, F.col("c_custkey") > 0, "restrict")
    except ValueError:
        return spark.sql("select true as refused")
    return spark.sql("select false as refused")


@query("select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then o_custkey + 1000000 else o_custkey end as o_custkey from orders")
def con_fk_update(spark, d):
    return X.update_parents(_customers(spark, d), read(spark, d, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", F.col("c_custkey") + 1000000, F.col("c_acctbal") < 0, "cascade")[1]


_STRICT = [("12.9", 12, 12, "12.90", "12.9 ", None), ("-3.5", -3, -3, "-3.50", "-3.5 ", None), ("40000", None, 40000, None, "40000", None), ("3000000000", None, None, None, "30000", None), ("abc", None, None, None, "abc  ", None), ("123E4567-e89b-12d3-a456-426614174000", None, None, None, "123E4", "123e4567-e89b-12d3-a456-426614174000"), (None, None, None, None, None, None)]


def _sql_value(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


@query(f"select x, small::smallint as small, whole::integer as whole, exact, fixed, uid from (values {', '.join('(' + ', '.join(map(_sql_value, r)) + ')' for r in _STRICT)}) t(x, small, whole, exact, fixed, uid)")
def con_strict(spark, d):
    x = F.col("x")
    rows = spark.createDataFrame([(r[0],) for r in _STRICT], "x string")
    return rows.select("x", coerce(x, "SMALLINT").alias("small"), coerce(x, "INT").alias("whole"), coerce(x, "DECIMAL(4,2)").cast("string").alias("exact"), coerce(x, "CHAR(5)").alias("fixed"), coerce(x, "UUID").alias("uid"))


@query("select s_suppkey, cast(null as varchar) as note, 5 as rating from supplier")
def ddl_alter_add(spark, d):
    return X.add_column(X.add_column(read(spark, d, "supplier").select("s_suppkey"), "note", "string"), "rating", "int", F.lit(5))


@query("select s_suppkey, s_nationkey, s_acctbal from supplier")
def ddl_alter_drop(spark, d):
    return read(spark, d, "supplier").drop("s_name")


@query("select * from supplier")
def ddl_alter_rename(spark, d):
    read(spark, d, "supplier").createOrReplaceTempView("vendor_old")
    spark.table("vendor_old").createOrReplaceTempView("vendor")
    spark.catalog.dropTempView("vendor_old")
    return spark.table("vendor")


@query("select o_orderkey as id, o_totalprice as v from orders where o_orderkey % 3 <> 0")
def tx_visibility(spark, d):
    """Rows written by 1 are seen; those deleted by 2, which was committed in time, are not; 3 came too late."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    rows = o.withColumns({"created_by": F.lit(1), "deleted_by": F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 3 == 1, 3)})
    late = o.filter("id < 100").withColumns({"v": F.lit(0.0), "created_by": F.lit(3), "deleted_by": F.lit(None).cast("int")})
    transactions = spark.sql("select * from values (1, 10), (2, 20), (3, 40), (4, null) as t(tx, committed_at)")
    return versions.visible(rows.unionByName(late), transactions, 5, 30).select("id", "v")


@query("select 'b' as tx, 1 as row, 'a' as first")
def tx_conflict(spark, d):
    writes = spark.sql("select * from values ('a', 1, 0, 5, 9), ('b', 1, 3, 7, 12), ('c', 2, 0, 1, 2), ('d', 2, 3, 4, 5) as t(tx, row, started_at, written_at, ended_at)")
    return versions.conflicts(writes)


@query("select tx from (values (1), (2), (3)) t(tx)")
def tx_deadlock(spark, d):
    return versions.deadlocked(spark.sql("select * from values (1, 2), (2, 3), (3, 1), (4, 1), (5, 6) as t(waiter, holder)"))


@query("select k, t as committed_at from (values (1, 7), (1, 12), (2, 3)) x(k, t)")
def tx_gc(spark, d):
    return versions.prune(spark.sql("select * from values (1, 2), (1, 7), (1, 12), (2, 1), (2, 3) as x(k, committed_at)"), ["k"], 10)

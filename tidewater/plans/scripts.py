"""Procedures, variables, and the client."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import changes as X
from tidewater.plans.registry import query
from tidewater.sources.database import Database

_LOOP = """
begin
  declare n int default :start;
  declare total int default 0;
  adding: loop
    if n > :stop then
      leave adding;
    elseif n % 2 = 0 then
      set total = total + n;
    end if;
    set n = n + 1;
  end loop adding;
  select total as total, n as n;
end"""


@query("select 30 as total, 11 as n")
def proc_loop(spark, d):
    db = Database(spark)
    db.create_procedure("evens", ["start", "stop"], _LOOP)
    return db.query("call evens(1, 10)")


@query("select c_mktsegment, count(*) as n from customer where c_acctbal > 5000 group by c_mktsegment")
def proc_call(spark, d):
    db = Database.open(spark, d, ["customer"])
    db.create_procedure("by_segment", ["least"], "begin select c_mktsegment, count(*) as n from customer where c_acctbal > :least group by c_mktsegment; end")
    return db.call("by_segment", [5000])


@query("select case when 7 % 2 = 0 then 'even' else 'odd' end as v")
def proc_if(spark, d):
    return spark.sql("begin declare x int default 7; if x % 2 = 0 then select 'even' as v; else select 'odd' as v; end if; end")


@query("select count(*) as n from part where p_size > 25")
def session_var(spark, d):
    db = Database.open(spark, d, ["part"])
    spark.sql("declare or replace variable least int default 20")
    spark.sql("set var least = least + 5")
    return db.query("select count(*) as n from part where p_size > least")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey = 33 or o_totalprice > 400000")
def api_prepare(spark, d):
    return Database.open(spark, d, ["orders"]).prepare("select o_orderkey, o_orderstatus from orders where o_orderkey = ? or o_totalprice > ?").bind(1, 33).bind(2, 400000.0).query()


@query("select count(*) as n, cast(count(*) as bigint) - (select count(*) from supplier where s_acctbal < 0) as changed from supplier")
def tx_rollback(spark, d):
    """What a transaction deletes is gone inside it, and back after its rollback."""
    db = Database.open(spark, d, ["supplier"])
    db.savepoint()
    db.change("supplier", lambda t: X.delete(t, F.col("s_acctbal") < 0))
    inside = db.table("supplier")
    db.rollback()
    a, b = db.query("select count(*) as n from supplier"), inside.agg(F.count(F.lit(1)).alias("changed"))
    return a.join(b, F.lit(True))  # one row each


@query("select 'query_cache_size' as name, '500' as value")
def pragma(spark, d):
    return Database(spark).query("PRAGMA query_cache_size = 500")


@query("select x, x * x as v from (values (2), (3)) t(x)")
def udf_registry(spark, d):
    spark.sql("create or replace temporary function squared(x int) returns int return x * x")
    return spark.sql("select x, squared(x) as v from values (2), (3) as t(x)")


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def udtf(spark, d):
    Database.open(spark, d, ["nation"])
    spark.sql("create or replace temporary function nations_of(r int) returns table (n_nationkey int, n_name string) return select n_nationkey, n_name from nation where n_regionkey = r")
    return spark.sql("select * from nations_of(2)")

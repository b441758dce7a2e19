"""CREATE TABLE with constraints that act, tables that last, triggers, and procedures with out parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewater.plans.registry import query
from tidewater.sources.database import Database, Trigger
from tidewater.sources.tables import read
from tidewater.sources.workers import shared_dir

_CREATE = "create table accounts (id bigint primary key, nation int not null references nation(n_nationkey), balance double check (balance > -1000), segment varchar(20) default 'NONE', unique (id, segment))"


def _accounts(spark, d) -> Database:
    db = Database.open(spark, d, ["nation"])
    db.query(_CREATE)
    customers = read(spark, d, "customer")
    db.insert("accounts", customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return db


def _refused(change) -> bool:
    try:
        change()
    except ValueError:
        return True
    return False


@query("select c_custkey as id, c_nationkey as nation, c_acctbal as balance, 'NONE' as segment from customer")
def ddl_create_table(spark, d):
    return _accounts(spark, d).query("select * from accounts")


@query("select c_custkey as id, c_nationkey as nation, c_acctbal as balance, 'NONE' as segment from customer")
def con_validate(spark, d):
    """Changes that break a constraint are refused, and leave the table as it was."""
    db = _accounts(spark, d)
    a = db.table("accounts")
    tries = [
        lambda: db.insert("accounts", a.limit(5)),
        lambda: db.insert("accounts", a.select((F.col("id") + 10**9).alias("id"), "balance")),
        lambda: db.insert("accounts", a.select((F.col("id") + 10**9).alias("id"), F.lit(99).alias("nation"))),
        lambda: db.update("accounts", {"balance": F.lit(-5000.0)}, F.col("id") % 7 == 0),
        lambda: db.update("accounts", {"id": F.lit(1)}),
        lambda: db.update("accounts", {"segment": F.lit("x" * 21)}, F.col("id") == 1),
        lambda: db.delete("nation", F.col("n_nationkey") < 20),
    ]
    done = [k for k, change in enumerate(tries) if not _refused(change)]
    return db.query("select * from accounts").filter(F.lit(not done))


@query("select c_custkey as id, cast(7 as integer) as nation, c_acctbal * 2 as balance from customer where c_acctbal > 0")
def dml_enforced(spark, d):
    db = _accounts(spark, d)
    db.update("accounts", {"nation": F.lit(7), "balance": F.col("balance") * 2}, F.col("balance") > 0)
    db.delete("accounts", F.col("balance") <= 0)
    return db.query("select id, nation, balance from accounts")


@query("select count(*) as n from customer")
def ddl_drop_table(spark, d):
    """A table that was dropped can be made anew, and is empty then."""
    db = _accounts(spark, d)
    db.query("drop table accounts")
    db.query(_CREATE)
    db.insert("accounts", read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit(0.0).alias("balance")))
    return db.query("select count(*) as n from accounts")


@query("select c_custkey as id, c_nationkey as nation, c_acctbal as balance, 'NONE' as segment from customer union all select 900000001, 3, 0.5, 'NEW'")
def src_file(spark, d):
    """Written to a folder, opened by another client, which keeps the constraints, and changed there."""
    path = f"{shared_dir(spark)}/database-{uuid.uuid4().hex}"
    _accounts(spark, d).save(path)
    db = Database.reopen(spark, path)
    db.put("nation", read(spark, d, "nation"))
    row = spark.sql("select 900000001 as id, 3 as nation, 0.5 as balance, 'NEW' as segment")
    db.insert("accounts", row)
    if not _refused(lambda: db.insert("accounts", row)):
        raise AssertionError("a repeated key was let in")
    return db.query("select * from accounts")


@query("select c_custkey as id, c_acctbal as was from customer where c_acctbal < 0")
def ddl_trigger_fire(spark, d):
    """What is deleted goes to a log; a trigger with a message refuses a change of other rows."""
    db = _accounts(spark, d)
    db.query("create table gone (id bigint primary key, was double)")
    db.create_trigger("log", Trigger("accounts", "delete", into="gone", select="select id, balance as was from changed"))
    db.create_trigger("keep", Trigger("accounts", "delete", when="balance > 0", message="only accounts in debt go"))
    refused = _refused(lambda: db.delete("accounts", F.col("balance") > 100))
    db.delete("accounts", F.col("balance") < 0)
    return db.query("select * from gone").filter(F.lit(refused))


@query("select count(*) as n, cast(sum(p_size) as bigint) as total from part where p_size > 25")
def proc_out(spark, d):
    db = Database.open(spark, d, ["part"])
    db.create_procedure("sizes", ["least", "out n bigint", "inout total bigint"], "begin set n = (select count(*) from part where p_size > :least); set total = total + (select sum(p_size) from part where p_size > :least); end")
    db.variables["@total"] = 0
    db.call("sizes", [25, "@n", "@total"])
    return spark.sql("select :n as n, :total as total", args={"n": db.variables["@n"], "total": db.variables["@total"]})


@query("select s_suppkey from supplier where s_acctbal >= 0 and s_nationkey <> 3")
def tx_rollback_to(spark, d):
    """SAVEPOINT, ROLLBACK TO, RELEASE and COMMIT: only what came after the savepoint is undone."""
    db = Database.open(spark, d, ["supplier"])
    db.savepoint()
    db.delete("supplier", F.col("s_acctbal") < 0)
    db.savepoint("a")
    db.delete("supplier", F.col("s_suppkey") > 0)
    db.rollback("a")
    db.release("a")
    db.delete("supplier", F.col("s_nationkey") == 3)
    db.release()
    return db.query("select s_suppkey from supplier")


for _name in ("current_date", "current_time", "localtime", "localtimestamp"):

    @query("select count(*) as n, cast(1 as bigint) as different from region", name=_name)
    def _clock(spark, d, name=_name):
        """The same moment for all rows of a query."""
        now = {"current_date": F.current_date(), "current_time": F.date_format(F.current_timestamp(), "HH:mm:ss"), "localtime": F.date_format(F.localtimestamp(), "HH:mm:ss"), "localtimestamp": F.localtimestamp()}[name]
        rows = read(spark, d, "region").withColumn("at", now)
        return rows.agg(F.count("at").alias("n"), F.countDistinct("at").alias("different"))

"""A small client over spark.sql: statements with parameters, views, tables as versions, procedures and settings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import changes
from tidewater.sources.schema import Schema, parse, parts
from tidewater.sources.tables import TABLES, register

#: The settings that PRAGMA knows, and what they are here; None is kept but has no effect.
PRAGMAS = {"page_cache_size": None, "query_cache_size": None, "vdbe_max_registers": None, "vdbe_max_cursors": None, "memory_budget": None, "result_streaming": None, "shuffle_partitions": "spark.sql.shuffle.partitions"}


@dataclass
class Statement:
    """A statement with ? for parameters, bound by position from 1."""

    database: Database
    sql: str
    values: dict[int, object] = field(default_factory=dict)

    def bind(self, position: int, value) -> Statement:
        self.values[position] = value
        return self

    def query(self) -> DataFrame:
        return self.database.query(self.sql, [self.values[k] for k in sorted(self.values)])


@dataclass
class Trigger:
    """A rule on the rows that an event ("insert", "update", "delete") adds, changes or takes.

    Where `when` holds for one of them: with a message the change is refused, else what `select` reads from the view
    `changed` is added to the table `into`.
    """

    table: str
    event: str
    when: str = "true"
    message: str | None = None
    into: str | None = None
    select: str = "select * from changed"


@dataclass
class Database:
    """Statements over one session. Tables are views of DataFrames; a change replaces a table's view by its next version."""

    spark: SparkSession
    procedures: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    settings: dict[str, object] = field(default_factory=dict)
    saved: list[tuple[str, dict[str, DataFrame]]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    schemas: dict[str, Schema] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    variables: dict[str, object] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str | None = None, names: Sequence[str] = TABLES) -> Database:
        db = cls(spark)
        if sf_dir:
            register(spark, sf_dir, names)
            db.tables |= {n: spark.table(n) for n in names}
        return db

    def query(self, sql: str, params: Sequence | Mapping | None = None) -> DataFrame:
        """The rows of a statement, as a lazy DataFrame. EXPLAIN and PRAGMA give rows too; CALL those of the body's last query."""
        text = sql.strip().rstrip(";")
        if m := re.fullmatch(r"(?is)pragma\s+(\w+)(?:\s*=\s*(\w+))?", text):
            return self.pragma(m[1].lower(), m[2])
        if m := re.fullmatch(r"(?is)call\s+(\w+)\s*\((.*)\)", text):
            return self.call(m[1], params if params is not None else parts(m[2]), literal=params is None)
        if m := re.fullmatch(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)", text):
            self.create_table(m[1].lower(), parse(m[2]), "not exists" in " ".join(text[:60].lower().split()))
            return self.tables[m[1].lower()]
        if m := re.fullmatch(r"(?is)drop\s+table\s+(?:if\s+exists\s+)?(\w+)", text):
            if m[1].lower() not in self.tables and not re.search(r"(?i)if\s+exists", text):
                raise ValueError(f"no table {m[1]}")
            self.drop(m[1].lower())
            return self.spark.range(0)
        if m := re.fullmatch(r"(?is)explain\s+query\s+plan\s+(.*)", text):
            return self.spark.sql(f"explain formatted {m[1]}")
        return self.spark.sql(text, args=params) if params else self.spark.sql(text)

    def prepare(self, sql: str) -> Statement:
        return Statement(self, sql)

    def pragma(self, name: str, value: str | None = None) -> DataFrame:
        if name not in PRAGMAS and name != "optimize_memory":
            raise ValueError(f"unknown setting {name}")
        if name == "optimize_memory":
            self.spark.catalog.clearCache()
        elif value is not None:
            self.settings[name] = value
            if PRAGMAS[name]:
                self.spark.conf.set(PRAGMAS[name], value)
        shown = self.settings.get(name) or (PRAGMAS.get(name) and self.spark.conf.get(PRAGMAS[name])) or ""
        return self.spark.sql("select :n as name, :v as value", args={"n": name, "v": str(shown)})

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def put(self, name: str, rows: DataFrame) -> None:
        """Makes rows the next version of a table."""
        self.tables[name] = rows
        rows.createOrReplaceTempView(name)

    def change(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        """Applies one of the changes of tidewater.operators.changes to a table."""
        self.put(name, f(self.tables[name]))

    def create_table(self, name: str, schema: Schema, if_missing: bool = False) -> None:
        """An empty table with constraints that insert, update, upsert and delete keep."""
        if name in self.tables:
            if if_missing:
                return
            raise ValueError(f"there is a table {name}")
        self.schemas[name] = schema
        self.put(name, schema.empty(self.spark))

    def insert(self, name: str, rows: DataFrame) -> None:
        """Adds rows, with defaults and strict types; ValueError, and no change, where a constraint or trigger forbids it."""
        new = self.schemas[name].typed(rows) if name in self.schemas else rows
        self._apply(name, "insert", changes.insert(self.tables[name], new), new)

    def update(self, name: str, assignments: Mapping[str, Column], where: Column | None = None) -> None:
        hit = self.tables[name] if where is None else self.tables[name].filter(where)
        changed = changes.update(hit, assignments)
        if name in self.schemas:
            changed = self.schemas[name].typed(changed)
        self._apply(name, "update", changes.delete(self.tables[name], F.lit(True) if where is None else where).unionByName(changed), changed)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], assignments: Mapping[str, Column] | None = None) -> None:
        new = self.schemas[name].typed(rows) if name in self.schemas else rows
        after = changes.upsert(self.tables[name], new, keys, assignments)
        self._apply(name, "insert", after, after.join(new.select(*keys).distinct(), list(keys), "left_semi").select(*after.columns))

    def delete(self, name: str, where: Column | None = None) -> None:
        """Takes rows away; ValueError where another table's foreign key refers to one."""
        gone = self.tables[name] if where is None else self.tables[name].filter(where)
        after = changes.delete(self.tables[name], where)
        for child, schema in self.schemas.items():
            for columns, table, there in schema.foreign:
                if table == name and not changes.violations_foreign_key(self.tables[child], after, dict(zip(columns, there, strict=True))).isEmpty():
                    raise ValueError(f"FOREIGN KEY: {child} refers to what is to be deleted")
        self._apply(name, "delete", after, gone)

    def _apply(self, name: str, event: str, after: DataFrame, changed: DataFrame) -> None:
        if event != "delete" and name in self.schemas:
            self.schemas[name].validate(after, changed, self.tables | {name: after})
        fired = []
        for t in self.triggers.values():
            if (t.table, t.event) == (name, event):
                rows = changed.filter(t.when)
                if t.message is not None and not rows.isEmpty():
                    raise ValueError(t.message)
                if t.into:
                    rows.createOrReplaceTempView("changed")
                    fired.append((t.into, self.spark.sql(t.select)))
        self.put(name, after)
        for into, rows in fired:
            self.insert(into, rows)

    def create_trigger(self, name: str, trigger: Trigger) -> None:
        self.triggers[name] = trigger

    def drop_trigger(self, name: str) -> None:
        del self.triggers[name]

    def save(self, path: str) -> None:
        """Writes all tables that were created, and their declarations, to a folder that every executor reaches."""
        for name in self.schemas:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        rows = [(n, json.dumps(s.json())) for n, s in self.schemas.items()]
        self.spark.createDataFrame(rows, "name string, declared string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_declared")

    @classmethod
    def reopen(cls, spark: SparkSession, path: str) -> Database:
        """The tables that save() wrote, with their constraints."""
        db = cls(spark)
        for name, declared in spark.read.parquet(f"{path}/_declared").collect():
            db.schemas[name] = Schema(**json.loads(declared))
            db.put(name, spark.read.parquet(f"{path}/{name}"))
        return db

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self.schemas.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def savepoint(self, name: str = "") -> None:
        """BEGIN and SAVEPOINT: remembers the tables as they are; DataFrames never change, so nothing is copied."""
        self.saved.append((name, dict(self.tables)))

    def rollback(self, name: str = "") -> None:
        """ROLLBACK [TO]: the tables as they were at the savepoint, which stays for ROLLBACK TO."""
        while self.saved:
            known, tables = self.saved[-1]
            if known == name:
                for gone in self.tables.keys() - tables.keys():
                    self.drop(gone)
                for t, rows in tables.items():
                    self.put(t, rows)
                if not name:
                    self.saved.pop()
                return
            self.saved.pop()
        raise ValueError(f"no savepoint {name}")

    def release(self, name: str = "") -> None:
        """RELEASE and COMMIT: forgets the savepoint and those after it."""
        while self.saved and self.saved.pop()[0] != name:
            pass

    def create_procedure(self, name: str, params: Sequence[str], body: str) -> None:
        """A body of SQL scripting (BEGIN ... END) that reads its parameters as :name.

        A parameter "out name type" or "inout name type" is a variable in the body; what it holds at the end is the
        result's one row, and goes to the variable that the caller names.
        """
        self.procedures[name.lower()] = (list(params), body)

    def drop_procedure(self, name: str) -> None:
        del self.procedures[name.lower()]

    def call(self, name: str, args: Sequence, literal: bool = False) -> DataFrame:
        """Runs a procedure. For an out parameter the argument is a variable's name, like "@total"; literal: arguments are SQL."""
        params, body = self.procedures[name.lower()]
        if len(args) != len(params):
            raise ValueError(f"{name} takes {len(params)} values")
        given, outs = {}, {}
        for p, a in zip(params, args, strict=True):
            mode, *rest = p.split()
            if rest and mode.lower() in ("out", "inout"):
                outs[rest[0]] = (a, " ".join(rest[1:]), self.variables.get(a) if mode.lower() == "inout" else None)
            else:
                given[p] = self.spark.sql(f"select {a}").first()[0] if literal else a
        if not outs:
            return self.spark.sql(body, args=given)
        first, last = re.search(r"(?i)\bbegin\b", body).end(), list(re.finditer(r"(?i)\bend\b", body))[-1].start()
        declared = " ".join(f"declare {v} {kind} default :_{v};" for v, (_, kind, _) in outs.items())
        script = f"{body[:first]} {declared} {body[first:last]} select {', '.join(f'{v} as {v}' for v in outs)}; {body[last:]}"
        result = self.spark.sql(script, args=given | {f"_{v}": value for v, (_, _, value) in outs.items()})
        row = result.first()
        self.variables |= {variable: row[v] for v, (variable, _, _) in outs.items()}
        return result

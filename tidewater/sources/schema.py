"""CREATE TABLE: columns with strict types, defaults and constraints, and the checks that a change must pass."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import changes
from tidewater.sources.tables import coerce

#: The type that a declared one is stored as; those not named here as they are.
STORED = {"text": "string", "varchar": "string", "char": "string", "uuid": "string", "guid": "string", "serial": "int", "bigserial": "bigint", "float": "double", "real": "double", "numeric": "decimal"}


@dataclass
class Schema:
    """A table's declaration. foreign: (columns, table, the columns there)."""

    columns: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)

    json = asdict

    def empty(self, spark) -> DataFrame:
        return spark.createDataFrame([], ", ".join(f"`{c}` {stored(kind)}" for c, kind in self.columns.items()))

    def typed(self, rows: DataFrame) -> DataFrame:
        """rows with all columns in their stored types, defaults where they lack one; ValueError where a value does not fit."""
        missing = {c: F.expr(self.defaults.get(c, "null")) for c in self.columns if c not in rows.columns}
        rows = rows.withColumns(missing).select(*(F.col(c).alias(c) for c in self.columns))
        strict = {c: coerce(F.col(c), kind) for c, kind in self.columns.items() if kind.partition("(")[0].lower() not in ("date", "timestamp", "boolean", "double", "string")}
        for c, value in strict.items():
            if not rows.filter(F.col(c).isNotNull() & value.isNull()).isEmpty():
                raise ValueError(f"a value does not fit {c} {self.columns[c]}")
        return rows.select(*(strict.get(c, F.col(c)).cast(stored(kind)).alias(c) for c, kind in self.columns.items()))

    def validate(self, after: DataFrame, changed: DataFrame, tables: Mapping[str, DataFrame]) -> None:
        """ValueError if a changed row breaks a constraint in the table as it is after the change. Only keys of changed rows are compared."""
        if self.not_null and not changes.violations_not_null(changed, self.not_null).isEmpty():
            raise ValueError(f"NOT NULL: one of {', '.join(self.not_null)}")
        for check in self.checks:
            if not changes.violations_check(changed, F.expr(check)).isEmpty():
                raise ValueError(f"CHECK: {check}")
        for keys in self.unique:
            touched = after.join(changed.select(*keys).distinct(), keys, "left_semi")
            if not changes.violations_unique(touched, keys).isEmpty():
                raise ValueError(f"UNIQUE: {', '.join(keys)}")
        for columns, table, there in self.foreign:
            if not changes.violations_foreign_key(changed, tables[table], dict(zip(columns, there, strict=True))).isEmpty():
                raise ValueError(f"FOREIGN KEY: {', '.join(columns)} refers to {table}")


def stored(kind: str) -> str:
    name, paren, rest = kind.lower().partition("(")
    known = STORED.get(name, name)
    return known if known == "string" else known + paren + rest


def parts(text: str) -> list[str]:
    """What commas separate, outside of parentheses and quotes."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def names(text: str) -> list[str]:
    return [x.strip('` "') for x in parts(text)]


def parse(body: str) -> Schema:
    """The declaration between the parentheses of CREATE TABLE."""
    out = Schema()
    for part in parts(body):
        if m := re.fullmatch(r"(?is)(?:constraint\s+\w+\s+)?(primary\s+key|unique)\s*\((.*)\)", part):
            out.unique.append(names(m[2]))
            out.not_null += names(m[2]) if m[1].lower().startswith("primary") else []
        elif m := re.fullmatch(r"(?is)(?:constraint\s+\w+\s+)?check\s*\((.*)\)", part):
            out.checks.append(m[1])
        elif m := re.match(r"(?is)(?:constraint\s+\w+\s+)?foreign\s+key\s*\((.*?)\)\s*references\s+(\w+)\s*\((.*?)\)", part):
            out.foreign.append((names(m[1]), m[2].lower(), names(m[3])))
        else:
            name, kind, rest = re.match(r"(?is)[`\"]?(\w+)[`\"]?\s+(\w+(?:\s*\([\d\s,]*\))?)\s*(.*)", part).groups()
            out.columns[name] = re.sub(r"\s", "", kind)
            if re.search(r"(?i)\bprimary\s+key\b", rest) or re.search(r"(?i)\bnot\s+null\b", rest):
                out.not_null.append(name)
            if re.search(r"(?i)\bprimary\s+key\b|\bunique\b", rest):
                out.unique.append([name])
            if m := re.search(r"(?is)\bdefault\s+('(?:[^']|'')*'|\([^)]*\)|[^\s]+)", rest):
                out.defaults[name] = m[1]
            if m := re.search(r"(?is)\bcheck\s*(\(.*\))", rest):
                out.checks.append(m[1])
            if m := re.search(r"(?is)\breferences\s+(\w+)\s*\((\w+)\)", rest):
                out.foreign.append(([name], m[1].lower(), [m[2]]))
    return out

"""The SQL surface: validated statements over registered tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import sqltext

MOST_ROWS = 100_000


@dataclass
class Result:
    """Columns and rows, as collected under the row limit."""

    columns: list[str]
    rows: list[list[Any]]
    meta: dict[str, Any] = field(default_factory=dict)


class Database:
    """Tables as views of one session. Reads are lazy DataFrames; limits hold only where rows are collected."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)
        self.applied: dict[str, str] = {}
        self.imported: set[str] = set()

    def query(self, text: str, parameters: list | dict | None = None) -> DataFrame:
        """One read-only statement; `?` or named parameters are bound by Spark, not pasted in."""
        sqltext.validate(text, list(parameters) if parameters is not None else None)
        words = [t.lower() for k, t in sqltext.tokens(text) if k == "word"]
        if not words or words[0] not in ("select", "values", "with"):
            raise sqltext.SqlError("only queries run here")
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=parameters) if parameters is not None else self.spark.sql(text)

    def all(self, text: str, parameters: list | dict | None = None) -> Result:
        df = self.query(text, parameters)
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise sqltext.SqlError(f"more than {MOST_ROWS} rows")
        return Result(df.columns, [list(r) for r in rows], {"rows_read": len(rows)})

    def create_table_as(self, name: str, text: str) -> None:
        self.tables[name] = self.query(text)

    def append(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = self.tables[name].unionByName(rows)

    def apply_migration(self, name: str, text: str) -> bool:
        """Statements `CREATE TABLE x AS query` of a file, once: False if it was applied before, an error if it has changed since."""
        digest = hashlib.sha256(text.encode()).hexdigest()
        if name in self.applied:
            if self.applied[name] != digest:
                raise sqltext.SqlError(f"migration {name} has changed since it was applied")
            return False
        made: dict[str, DataFrame] = {}
        for statement in sqltext.statements(text):
            words = statement.split(None, 4)
            if [w.lower() for w in words[:2]] != ["create", "table"] or words[3].lower() != "as":
                raise sqltext.SqlError("a migration holds CREATE TABLE name AS query")
            made[words[2]] = Database(self.spark, {**self.tables, **made}).query(words[4])
        self.tables.update(made)
        self.applied[name] = digest
        return True

    def import_script(self, text: str) -> bool:
        """As a migration named by its content: the same script again does nothing."""
        digest = hashlib.sha256(text.encode()).hexdigest()
        if digest in self.imported:
            return False
        self.apply_migration(digest, text)
        self.imported.add(digest)
        return True

    def dump_rows(self, name: str) -> DataFrame:
        """INSERT statements of a table, one a row, made on the executors."""
        df = self.tables[name]
        parts = []
        for c, kind in df.dtypes:
            x = F.col(f"`{c}`")
            if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
                text = x.cast("string")
            elif kind in ("float", "double"):
                text = F.when(F.isnan(x), F.lit("NULL")).when(x == float("inf"), F.lit("9e999")).when(x == float("-inf"), F.lit("-9e999")).otherwise(x.cast("string"))
            elif kind == "boolean":
                text = x.cast("int").cast("string")
            elif kind == "binary":
                text = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
            else:
                text = F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
            parts.append(F.coalesce(text, F.lit("NULL")))
        head = f"INSERT INTO {sqltext.identifier(name)} VALUES("
        return df.select(F.concat(F.lit(head), F.concat_ws(",", *parts), F.lit(");")).alias("statement"))

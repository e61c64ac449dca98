"""Tables by name: create, append, list, describe, change, drop, with a registry of their schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.schema import Column
from ..sources.shared import written

REGISTRY = "table_registry"


class Catalog:
    """The tables of one group of files, in a database of Spark's catalog."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def create(self, table: str, df: DataFrame, columns: list[Column] = ()) -> None:
        """Writes df as a new table with an id for each row, and notes its schema. An existing one is replaced."""
        self.drop(table)
        clean = df.select(*[(S.strip_nul(F.col(f"`{c}`")) if kind == "string" else F.col(f"`{c}`")).alias(c) for c, kind in df.dtypes])
        clean.withColumn("id", F.uuid()).write.mode("overwrite").saveAsTable(self._name(table))
        self._note(table, columns)

    def _note(self, table: str, columns: list[Column] = ()) -> None:
        schema = self.spark.table(self._name(table)).schema.json()
        row = self.spark.range(1).select(F.lit(table).alias("table_name"), F.lit(schema).alias("schema_json"), F.lit(self.display(table)).alias("display_name"), F.current_timestamp().alias("created_at"))
        row.write.mode("append").saveAsTable(self._name(REGISTRY))

    @staticmethod
    def display(table: str) -> str:
        return table.replace("_", " ").title()

    def append(self, table: str, df: DataFrame) -> int:
        """Adds rows in one write; columns the table doesn't have are dropped, missing ones are null. Gives the row count."""
        have = dict(self.spark.table(self._name(table)).dtypes)
        out = df.select(*[(F.uuid() if c == "id" else F.col(f"`{c}`").try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in have.items()])
        out.write.mode("append").insertInto(self._name(table))
        return self.spark.table(self._name(table)).count()

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if t.name != REGISTRY and not t.isTemporary)  # views of the session are no tables of ours

    def describe(self, table: str) -> str:
        """The schema as JSON."""
        return self.spark.table(self._name(table)).schema.json()

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def registry(self) -> DataFrame:
        """The latest entry of each table."""
        r = self.spark.table(self._name(REGISTRY))
        return r.groupBy("table_name").agg(F.max_by(F.struct("schema_json", "display_name", "created_at"), "created_at").alias("r")).select("table_name", "r.*").where(F.col("table_name").isin(self.tables()))

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")

    def add_column(self, table: str, column: Column) -> None:
        kind = S.SPARK_TYPE[S.STORE_TYPE[column.sql_type]]
        self.spark.sql(f"ALTER TABLE {self._name(table)} ADD COLUMNS (`{column.name}` {kind})")
        self._note(table)

    def remove_column(self, table: str, name: str) -> None:
        self._rewrite(table, self.table(table).drop(name))

    def change(self, table: str, changes: DataFrame) -> None:
        """Many changes in one write. changes: id, seq, deleted, values (a map of column to text).

        Of a row's changes the last by seq that sets a column decides on it; a
        deleted row stays deleted. Unknown ids and columns change nothing. What no
        change names passes by an anti-join and is never computed anew.
        """
        df = self.table(table)
        own = changes.where("id is not null")
        set_ = own.select("id", "seq", F.explode_outer("values").alias("name", "value"))
        last = set_.where("name is not null").groupBy("id", "name").agg(F.max_by(F.struct("value"), "seq").alias("v"))
        values = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v.value"))).alias("__values"))
        gone = own.groupBy("id").agg(F.max("deleted").alias("__gone"))
        asked = written(gone.join(values, "id", "left"))
        met = df.join(asked.where("not __gone"), "id")
        new = [F.col("id") if c == "id" else F.when(F.map_contains_key(F.col("__values"), F.lit(c)), F.col("__values")[c].try_cast(kind)).otherwise(F.col(f"`{c}`")).alias(c) for c, kind in df.dtypes]
        self._rewrite(table, df.join(asked, "id", "left_anti").select(*df.columns).unionByName(met.select(*new)))

    def _changed(self, row_id: str, deleted: bool, values: dict[str, object]) -> DataFrame:
        text = {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
        return self.spark.createDataFrame([(row_id, 1, deleted, text)], "id string, seq long, deleted boolean, values map<string,string>")

    def update(self, table: str, row_id: str, values: dict[str, object]) -> None:
        """Sets values in the row with this id; for many rows see change()."""
        self.change(table, self._changed(row_id, False, values))

    def delete(self, table: str, row_id: str) -> None:
        self.change(table, self._changed(row_id, True, {}))

    def get(self, table: str, row_id: str) -> DataFrame:
        return self.table(table).where(F.col("id") == row_id)

    def _rewrite(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").saveAsTable(self._name(f"{table}__new"))
        self.drop(table)
        self.spark.sql(f"ALTER TABLE {self._name(table + '__new')} RENAME TO {self._name(table)}")
        self._note(table)

    def expose(self) -> set[str]:
        """Temp views under the tables' own names, and information_schema_columns, for SQL; gives their names."""
        names = set()
        for t in self.tables():
            self.table(t).createOrReplaceTempView(t)
            names.add(t)
        rows = [(t, c, kind, k) for t in self.tables() for k, (c, kind) in enumerate(self.table(t).dtypes, 1)]
        self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int").createOrReplaceTempView("information_schema_columns")
        return names | {"information_schema_columns"}

    def context(self, rows: int = 5) -> dict[str, list[dict]]:
        """The first rows of each table, for a prompt or a preview."""
        return {t: [r.asDict(recursive=True) for r in self.table(t).limit(rows).collect()] for t in self.tables()}

    def discover(self, n: int = 200) -> list[dict]:
        """Names, columns and row counts of the tables, by name; one job counts them all."""
        names = self.tables()[:n]
        counts = [self.table(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in names]
        found = {r.table_name: r.n for r in reduce(DataFrame.unionByName, counts).collect()} if counts else {}
        return [{"table_name": t, "columns": self.table(t).columns, "row_count": found[t]} for t in names]

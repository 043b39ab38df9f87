"""A catalog in files: `<warehouse>/<database>/<table>.json` points to a table's newest metadata document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakesnap.errors import Conflict, NotFound
from lakesnap.sources.documents import Store

NAME = re.compile(r"[A-Za-z0-9_-]+")


def checked(name: str, what: str) -> str:
    name = (name or "").strip()
    if not NAME.fullmatch(name):
        raise ValueError(f"{what} must be letters, digits, _ or -: {name!r}")
    return name


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str, name: str = "lakesnap"):
        self.spark, self.warehouse, self.name, self.store = spark, warehouse.rstrip("/"), checked(name, "catalog"), Store(spark)

    def _pointer(self, db: str, table: str) -> str:
        return f"{self.warehouse}/{checked(db, 'database')}/{checked(table, 'table')}.json"

    def create_database(self, db: str) -> None:
        """Does nothing if it exists."""
        path = f"{self.warehouse}/{checked(db, 'database')}/.database"
        if not self.store.exists(path):
            self.store.write(path, b"{}", overwrite=True)

    def databases(self) -> list[str]:
        return [x for x in self.store.names(self.warehouse) if self.store.exists(f"{self.warehouse}/{x}/.database")]

    def exists(self, db: str, table: str) -> bool:
        return self.store.exists(self._pointer(db, table))

    def tables(self, db: str) -> list[str]:
        return [x.removesuffix(".json") for x in self.store.names(f"{self.warehouse}/{checked(db, 'database')}") if x.endswith(".json") and not x.startswith(".")]

    def list_tables(self, db: str) -> DataFrame:
        return self.spark.createDataFrame([(db, t) for t in self.tables(db)], "namespace string, table_name string")

    def pointer(self, db: str, table: str) -> dict[str, str]:
        """location and metadata_location."""
        try:
            return self.store.read_json(self._pointer(db, table))
        except NotFound:
            raise NotFound(f"table {db}.{table}") from None

    def register(self, db: str, table: str, location: str, metadata_location: str, *, overwrite: bool = False) -> None:
        """Names existing metadata. Nothing is ever purged to make room."""
        if not overwrite and self.exists(db, table):
            raise Conflict(f"table {db}.{table} exists")
        self.create_database(db)
        self.store.write_json(self._pointer(db, table), {"location": location, "metadata_location": metadata_location}, overwrite)

    def swap(self, db: str, table: str, before: str, location: str, after: str) -> None:
        """Moves the pointer to `after`, which its writer has published as the version after `before`. Conflict if the
        table has been replaced meanwhile; a pointer that lags behind is put right by whoever writes next."""
        if self.pointer(db, table)["metadata_location"].rsplit("/", 1)[0] != before.rsplit("/", 1)[0]:
            raise Conflict(f"{db}.{table} has changed")
        self.store.write_json(self._pointer(db, table), {"location": location, "metadata_location": after}, overwrite=True)

    def sql(self, text: str, **tables: str) -> DataFrame:
        """Any SQL; {name} in it stands for a table given as name="db.table". Errors are raised, results never collected."""
        from lakesnap.operators.table import Table

        return self.spark.sql(text, **{k: Table(self, *v.split(".", 1)).scan() for k, v in tables.items()})

    def drop_table(self, db: str, table: str, purge: bool = False) -> bool:
        """False if there is none."""
        if not self.exists(db, table):
            return False
        location = self.pointer(db, table)["location"]
        self.store.delete(self._pointer(db, table))
        if purge:
            self.store.delete(location)
        return True

    def clean_database(self, db: str, purge: bool = False) -> list[str]:
        """Drops all tables; their names."""
        return [t for t in self.tables(db) if self.drop_table(db, t, purge)]

    def describe(self, db: str, table: str) -> DataFrame:
        return self.spark.createDataFrame(sorted({**self.pointer(db, table), "name": f"{self.name}.{db}.{table}", "provider": "lakesnap"}.items()), "col_name string, data_type string")

"""Snapshot tables: immutable Parquet files, manifests that list them, a metadata document, a pointer to it.

A commit writes data, then manifests, then the metadata document of the next version, whose name follows from the one
that the writer has read: of two writers, one finds it there and fails. The catalog's pointer moves last, and only says
where to begin; a later version that is there counts. Readers choose a snapshot, list its files from manifests (with files skipped by partition
and bounds) and hand them to Spark's Parquet reader, so pushdown and pruning stay.
"""

from __future__ import annotations

import random
import re
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesnap.errors import Conflict, NotFound
from lakesnap.functions.paths import canonical, canonical_text
from lakesnap.operators.ancestry import chain
from lakesnap.operators.deletes import applied, with_ids
from lakesnap.schemas import ENTRY, MANIFEST_LIST, SNAPSHOT
from lakesnap.sources.catalog import Catalog

BOUNDED = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)

VERSION = re.compile(r"(.*/)(\d+)-([^/]+)\.metadata\.json")


def next_version(path: str) -> str:
    """The only name that the version after a metadata document can have."""
    m = VERSION.fullmatch(path)
    folder, n, line = (m[1], int(m[2]), m[3]) if m else (path.rsplit("/", 1)[0] + "/", 0, uuid.uuid5(uuid.NAMESPACE_URL, path))
    return f"{folder}{n + 1:05d}-{line}.metadata.json"


class Table:
    def __init__(self, catalog: Catalog, db: str, name: str):
        self.catalog, self.db, self.name, self.spark, self.store = catalog, db, name, catalog.spark, catalog.store

    # -- metadata

    @classmethod
    def create(cls, catalog: Catalog, db: str, name: str, schema: T.StructType | str, location: str | None = None, day_of: str | None = None, if_not_exists: bool = True) -> Table:
        """An empty table. day_of: a time column by whose day files are kept apart."""
        out = cls(catalog, db, name)
        if catalog.exists(db, name):
            if if_not_exists:
                return out
            raise Conflict(f"table {db}.{name} exists")
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        location = canonical_text(catalog.store.qualified(location or f"{catalog.warehouse}/{db}/{name}"))
        metadata = {
            "format-version": 2, "table-uuid": str(uuid.uuid4()), "location": location, "schema": schema.jsonValue(), "partition-day": day_of, "current-snapshot-id": None,
            "snapshots": [], "snapshot-log": [], "metadata-log": [], "properties": {}, "last-sequence-number": 0,
        }
        path = f"{location}/metadata/00000-{uuid.uuid4()}.metadata.json"
        catalog.store.write_json(path, metadata)
        catalog.register(db, name, location, path)
        return out

    def current(self) -> str:
        """The newest metadata document: the pointer's, or what a writer has put after it."""
        path = self.catalog.pointer(self.db, self.name)["metadata_location"]
        while self.store.exists(after := next_version(path)):
            path = after
        return path

    def metadata(self) -> dict[str, Any]:
        return self.store.read_json(self.current())

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.metadata()["schema"])

    def snapshot(self, snapshot_id: int | None = None, as_of_ms: int | None = None) -> dict[str, Any] | None:
        """By id, or the last at a time, or the current one; None if the table has none yet."""
        return self._snapshot(self.metadata(), snapshot_id, as_of_ms)

    @staticmethod
    def _snapshot(m: dict[str, Any], snapshot_id: int | None = None, as_of_ms: int | None = None) -> dict[str, Any] | None:
        if snapshot_id is not None:
            found = [s for s in m["snapshots"] if s["snapshot-id"] == snapshot_id]
            if not found:
                raise NotFound(f"snapshot {snapshot_id}")
            return found[0]
        line = chain(m["snapshots"], m["current-snapshot-id"]) if m["current-snapshot-id"] is not None else []
        if as_of_ms is not None:
            line = [s for s in line if s["timestamp-ms"] <= as_of_ms]
            if not line:
                raise NotFound(f"no snapshot at {as_of_ms}")
        return line[-1] if line else None

    # -- views

    def snapshots(self) -> DataFrame:
        rows = [{**s, "summary": s.get("summary")} for s in self.metadata()["snapshots"]]
        names = [c.split("`")[1] if c.strip().startswith("`") else c.split()[0] for c in SNAPSHOT.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SNAPSHOT)

    def history(self) -> DataFrame:
        """made_current_at, snapshot_id, parent_id, is_current_ancestor."""
        m = self.metadata()
        line = {s["snapshot-id"] for s in chain(m["snapshots"], m["current-snapshot-id"])}
        parents = {s["snapshot-id"]: s.get("parent-snapshot-id") for s in m["snapshots"]}
        rows = [(x["timestamp-ms"], x["snapshot-id"], parents.get(x["snapshot-id"]), x["snapshot-id"] in line) for x in m["snapshot-log"]]
        return self.spark.createDataFrame(rows, "made_current_ms bigint, snapshot_id bigint, parent_id bigint, is_current_ancestor boolean")

    def metadata_log(self) -> DataFrame:
        """timestamp_ms, file, the newest included."""
        now = self.current()
        m = self.store.read_json(now)
        rows = [(x["timestamp-ms"], x["metadata-file"]) for x in m["metadata-log"]]
        last = m["snapshots"][-1]["timestamp-ms"] if m["snapshots"] else 0
        return self.spark.createDataFrame([*rows, (max([last, *(t for t, _ in rows)]), now)], "timestamp_ms bigint, file string")

    def latest_metadata(self) -> DataFrame:
        return self.metadata_log().orderBy(F.col("timestamp_ms").desc(), F.col("file").desc()).limit(1)

    def manifests(self, snapshot: dict[str, Any] | None = None) -> DataFrame:
        s = snapshot or self.snapshot()
        return self.spark.read.schema(MANIFEST_LIST).parquet(s["manifest-list"]) if s else self.spark.createDataFrame([], MANIFEST_LIST)

    def entries(self, snapshot: dict[str, Any] | None = None) -> DataFrame:
        paths = [r.manifest_path for r in self.manifests(snapshot).select("manifest_path").distinct().collect()]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def files(self, snapshot: dict[str, Any] | None = None) -> DataFrame:
        """Files that the snapshot reads: what later manifests have deleted is left out."""
        e = self.entries(snapshot)
        gone = e.where("status = 2").select(F.col("data_file.file_path").alias("__gone"))
        return e.where("status <> 2").select("data_file.*").join(gone, F.col("file_path") == F.col("__gone"), "left_anti")

    # -- reading

    def scan(self, snapshot_id: int | None = None, as_of_ms: int | None = None, days: tuple[str, str] | None = None, between: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """The rows of a snapshot. days: first and last day wanted, for tables kept by day; between: bounds of text
        columns. Both skip files; a filter on the rows is still the caller's."""
        return self._rows(self.snapshot(snapshot_id, as_of_ms), days, between, False)

    def _rows(self, snapshot: dict[str, Any] | None, days: tuple[str, str] | None, between: dict[str, tuple[str, str]] | None, places: bool) -> DataFrame:
        schema = self.schema
        files = self.files(snapshot).persist()
        try:
            data = files.where("content = 0")
            if days:
                data = data.where(F.col("partition").isNull() | F.col("partition").between(*days))
            for name, (low, high) in (between or {}).items():
                k = schema.names.index(name)
                at = lambda c, k=k: F.element_at(F.filter(c, lambda b: b["key"] == k), 1)["value"].cast("string")
                first, last = at("lower_bounds"), at("upper_bounds")
                data = data.where(first.isNull() | ((first <= high) & (last >= low)))
            paths = [r.file_path for r in data.select("file_path").collect()]
            deletes = files.where("content = 1").select("file_path", "record_count").collect()
        finally:
            files.unpersist()
        if not paths:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"__path": F.lit(""), "__pos": F.lit(0).cast("long")}) if places else empty
        rows = self.spark.read.schema(schema).parquet(*paths)
        if not (places or deletes):
            return rows
        rows = rows.select(*schema.names, canonical(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.row_index").alias("__pos"))
        if deletes:
            counts = [r.record_count for r in deletes]
            rows = applied(rows, self.spark.read.parquet(*(r.file_path for r in deletes)), n=None if None in counts else sum(counts))
        return rows if places else rows.select(*schema.names)

    def count(self, snapshot_id: int | None = None) -> DataFrame:
        return self.scan(snapshot_id).agg(F.count("*").alias("count"))

    # -- writing

    def append(self, rows: DataFrame) -> int:
        """Adds rows (columns by name) as a new snapshot; its id."""
        return self._commit("append", [self._write(rows)])

    def insert(self, tuples: list[tuple]) -> int:
        """Adds rows given by position; values are checked against the table's types."""
        return self.append(self.spark.createDataFrame(tuples, self.schema))

    def overwrite(self, rows: DataFrame) -> int:
        """Rows instead of all that the table has."""
        before = self.files().select(F.lit(2).alias("status"), F.struct("*").alias("data_file"))
        return self._commit("overwrite", [self._write(rows)], gone=before)

    def delete_where(self, condition: Column | str) -> int:
        """Marks the rows where condition holds as deleted, by file and position."""
        hit = self._rows(self.snapshot(), None, None, True).where(condition).select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos"))
        return self._commit("delete", [self._write_deletes(hit)])

    def merge(self, source: DataFrame, on: list[str], update: list[str] | None = None, insert: bool = False) -> int:
        """Rows that match source on `on` take its values of `update` (default: all its other columns); with insert,
        rows of source that match nothing are added. Only rows that match are written again. Several source rows for
        one key are an error."""
        schema = self.schema
        update = [c for c in schema.names if c in source.columns and c not in on] if update is None else update
        keys = source.groupBy(*on).agg(F.count("*").alias("__n"))
        checked = source.join(keys, on).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit("several source rows match one key"))).otherwise(F.col("__n")))
        s = checked.select(*(F.col(c).alias(f"__k_{c}") for c in on), *(F.col(c).alias(f"__s_{c}") for c in update), "__n")
        now = self._rows(self.snapshot(), None, None, True)
        hit = now.join(s, [now[c] == s[f"__k_{c}"] for c in on]).where("__n = 1")
        new = hit.select(*((F.col(f"__s_{c}") if c in update else F.col(c)).cast(schema[c].dataType).alias(c) for c in schema.names))
        parts = [self._write_deletes(hit.select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos"))), self._write(new)]
        if insert:
            left = source.join(now.select(*on).distinct(), on, "left_anti")
            parts.append(self._write(left.select(*((F.col(c) if c in source.columns else F.lit(None)).cast(schema[c].dataType).alias(c) for c in schema.names))))
        return self._commit("merge", parts)

    def set_property(self, key: str, value: str) -> None:
        before = self.current()
        m = self.store.read_json(before)
        self._save({**m, "properties": {**m["properties"], key: value}}, before)

    def expire(self, keep: int) -> list[int]:
        """Forgets all but the last `keep` snapshots of the current line; their ids. Files stay: backups may share them."""
        before = self.current()
        m = self.store.read_json(before)
        line = chain(m["snapshots"], m["current-snapshot-id"])
        stay = {s["snapshot-id"] for s in line[-max(1, keep) :]}
        gone = [s["snapshot-id"] for s in m["snapshots"] if s["snapshot-id"] not in stay]
        kept = [{k: v for k, v in s.items() if k != "parent-snapshot-id" or v in stay} for s in m["snapshots"] if s["snapshot-id"] in stay]
        self._save({**m, "snapshots": kept, "snapshot-log": [x for x in m["snapshot-log"] if x["snapshot-id"] in stay]}, before)
        return gone

    def _location(self) -> str:
        return self.catalog.pointer(self.db, self.name)["location"]

    def _write(self, rows: DataFrame) -> DataFrame:
        """Data files of rows -> data_file structs, with counts and bounds from one pass over what was written."""
        m = self.metadata()
        schema, day = T.StructType.fromJson(m["schema"]), m.get("partition-day")
        path = f"{m['location']}/data/{uuid.uuid4().hex}"
        out = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        if day:
            # a day's rows are brought together; Spark splits days that are too large for one task
            out = out.withColumn("__day", F.date_format(day, "yyyy-MM-dd")).hint("rebalance", "__day")
            out.write.partitionBy("__day").parquet(path)
        else:
            out.write.parquet(path)
        back = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        file = F.col("_metadata.file_path")
        back = back.select(*schema.names, file.alias("__path"), F.col("_metadata.file_size").alias("__size"))
        bounded = [(k, f.name) for k, f in enumerate(schema) if isinstance(f.dataType, BOUNDED)]
        aggs = [F.count("*").alias("n"), *(F.count(F.col(f"`{f.name}`")).alias(f"c{k}") for k, f in enumerate(schema))]
        aggs += [x for k, n in bounded for x in (F.min(f"`{n}`").alias(f"l{k}"), F.max(f"`{n}`").alias(f"u{k}"))]
        g = back.groupBy("__path", "__size").agg(*aggs)
        counts = lambda c: F.map_from_arrays(F.array(*(F.lit(k) for k in range(len(schema)))), F.array(*(c(k) for k in range(len(schema)))))
        bounds = lambda p: F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"{p}{k}").cast("string").cast("binary").alias("value")) for k, _ in bounded)), lambda b: b["value"].isNotNull()) if bounded else F.lit(None)
        day_of = F.nullif(F.regexp_extract("__path", r"/__day=([0-9-]+)/", 1), F.lit("")) if day else F.lit(None)
        return g.select(
            F.lit(0).alias("content"), canonical(F.col("__path")).alias("file_path"), F.lit("PARQUET").alias("file_format"), day_of.cast("string").alias("partition"), F.col("n").alias("record_count"), F.col("__size").alias("file_size_in_bytes"),
            counts(lambda k: F.col("n")).alias("value_counts"), counts(lambda k: F.col("n") - F.col(f"c{k}")).alias("null_value_counts"), bounds("l").alias("lower_bounds"), bounds("u").alias("upper_bounds"),
        )

    def _write_deletes(self, hit: DataFrame) -> DataFrame:
        path = f"{self._location()}/data/deletes-{uuid.uuid4().hex}"
        with_ids(hit).write.option("compression", "zstd").parquet(path)
        back = self.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_size").alias("__size"))
        g = back.groupBy("__path", "__size").agg(F.count("*").alias("n"))
        null = lambda t, n: F.lit(None).cast(t).alias(n)
        return g.select(
            F.lit(1).alias("content"), canonical(F.col("__path")).alias("file_path"), F.lit("PARQUET").alias("file_format"), null("string", "partition"), F.col("n").alias("record_count"), F.col("__size").alias("file_size_in_bytes"),
            null("map<int,bigint>", "value_counts"), null("map<int,bigint>", "null_value_counts"), null("array<struct<key:int,value:binary>>", "lower_bounds"), null("array<struct<key:int,value:binary>>", "upper_bounds"),
        )

    def _commit(self, operation: str, parts: list[DataFrame], gone: DataFrame | None = None) -> int:
        before = self.current()  # read once: what is based on it is published after it, or not at all
        m = self.store.read_json(before)
        now = self._snapshot(m)
        new_id, ms = random.getrandbits(62), max(int(time.time() * 1000), (now or {}).get("timestamp-ms", 0) + 1)
        location, lists = m["location"], []
        if now:
            lists.append(self.manifests(now))
        for content, files in ((0, parts), (1, parts)):
            rows = None
            for p in files:
                e = p.where(F.col("content") == content).select(F.lit(1).alias("status"), F.struct("*").alias("data_file"))
                rows = e if rows is None else rows.unionByName(e)
            if gone is not None and content == 0:
                rows = rows.unionByName(gone)
            path = f"{location}/metadata/{uuid.uuid4().hex}-m{content}"
            rows.select("status", F.lit(new_id).alias("snapshot_id"), "data_file").to(T.StructType.fromDDL(ENTRY)).write.parquet(path)
            n = self.spark.read.schema(ENTRY).parquet(path).count()
            if n:
                lists.append(self.spark.createDataFrame([(path, self.store.size(path), content, new_id, n)], MANIFEST_LIST))
        list_path = f"{location}/metadata/snap-{new_id}-{uuid.uuid4().hex}"
        every = lists[0] if lists else self.spark.createDataFrame([], MANIFEST_LIST)
        for x in lists[1:]:
            every = every.unionByName(x)
        every.coalesce(1).write.parquet(list_path)  # a row for each commit
        s = {"snapshot-id": new_id, "timestamp-ms": ms, "sequence-number": m["last-sequence-number"] + 1, "manifest-list": list_path, "summary": {"operation": operation}}
        if now:
            s["parent-snapshot-id"] = now["snapshot-id"]
        self._save({
            **m, "current-snapshot-id": new_id, "snapshots": [*m["snapshots"], s], "snapshot-log": [*m["snapshot-log"], {"timestamp-ms": ms, "snapshot-id": new_id}], "last-sequence-number": m["last-sequence-number"] + 1,
        }, before, ms)
        return new_id

    def _save(self, metadata: dict[str, Any], before: str, ms: int | None = None) -> None:
        """Publishes the version after `before`; Conflict if there is one already."""
        log = [*metadata["metadata-log"], {"timestamp-ms": ms or int(time.time() * 1000), "metadata-file": before}]
        path = next_version(before)
        self.store.write_json(path, {**metadata, "metadata-log": log})
        self.catalog.swap(self.db, self.name, before, metadata["location"], path)

"""Restores: a backup becomes a table of another name and place.

Order: data files, rewritten delete files, manifests, lists, the metadata document, and only then the catalog's
pointer. Nothing that exists is dropped to make room.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesnap import logs
from lakesnap.errors import Conflict
from lakesnap.functions.paths import canonical_text, relocate_bounds, restore_path
from lakesnap.operators.backup import opened
from lakesnap.operators.copying import copied, judged
from lakesnap.operators.deletes import rewritten
from lakesnap.operators.manifests import data_only, patched_sizes
from lakesnap.operators.table import Table
from lakesnap.schemas import ENTRY, MANIFEST_LIST
from lakesnap.sources.catalog import Catalog, checked
from lakesnap.sources.documents import Store


def restored_metadata(abstracted: dict[str, Any], location: str, lists: dict[int, str]) -> dict[str, Any]:
    """The metadata document at its new place; `write.*.path` properties that name a place are pointed there."""
    out = copy.deepcopy(abstracted) | {"location": location}
    for s in out["snapshots"]:
        if s.get("manifest-list"):
            s["manifest-list"] = lists.get(s["snapshot-id"], f"{location}/{s['manifest-list']}")
    for key, folder in (("write.object-storage.path", "data"), ("write.data.path", "data"), ("write.metadata.path", "metadata")):
        if key in (out.get("properties") or {}):
            out["properties"][key] = f"{location}/{folder}"
    out["snapshot-log"] = [{"timestamp-ms": s["timestamp-ms"], "snapshot-id": s["snapshot-id"]} for s in out["snapshots"]]
    return out


def restore(catalog: Catalog, root: str, name: str, db: str, table: str, location: str | None = None, *, overwrite: bool = False, options: Mapping[str, str] | None = None) -> Table:
    """Puts a backup into the catalog as db.table at location. An existing table, or metadata at location, is an error
    unless overwrite; even then its files stay."""
    spark, store, log = catalog.spark, Store(catalog.spark), logs.get("restore")
    root = store.qualified(root)
    home = f"{root.rstrip('/')}/{checked(name, 'backup name')}"
    document = opened(store, root, name)
    db, table = checked(db, "database"), checked(table, "table")
    location = canonical_text(store.qualified(location or f"{catalog.warehouse}/{db}/{table}"))
    if not overwrite and (catalog.exists(db, table) or store.exists(f"{location}/metadata")):
        raise Conflict(f"{db}.{table} or {location} exists")
    old = canonical_text(document["original_location"])
    files = spark.read.parquet(f"{home}/files")
    source, target = F.concat_ws("/", "home", "path").alias("src"), restore_path(F.col("path"), location).alias("dst")

    deletes = files.where("content = 1")
    done = f"{home}/restores/{uuid.uuid4().hex}"
    plain = data_only(files, deletes)
    copied(plain.select(source, target, "size"), options=options).write.parquet(f"{done}/copied")
    counts = judged(spark.read.parquet(f"{done}/copied"))
    rewritten(spark, deletes.select(source, target), old, location, options).write.parquet(f"{done}/deletes")
    sizes = spark.read.parquet(f"{done}/deletes")

    entries = spark.read.parquet(f"{home}/entries")
    f = F.col("data_file")
    here = f.withField("file_path", restore_path(f["file_path"], location))
    for b in ("lower_bounds", "upper_bounds"):
        here = here.withField(b, relocate_bounds(f[b], old, location))
    entries = patched_sizes(entries.withColumn("data_file", here), sizes)
    manifests = spark.read.parquet(f"{home}/manifests")
    # manifests are few: one for each commit and kind
    made = {}
    entry = T.StructType.fromDDL(ENTRY)
    for r in manifests.select("manifest_path").distinct().collect():
        path = f"{location}/{r.manifest_path}"
        entries.where(F.col("manifest_path") == r.manifest_path).drop("manifest_path").to(entry).write.mode("overwrite").parquet(path)
        made[r.manifest_path] = store.size(path)
    lengths = spark.createDataFrame(list(made.items()), "manifest_path string, __length bigint")
    manifests = manifests.join(F.broadcast(lengths), "manifest_path").withColumn("manifest_length", F.col("__length")).withColumn("manifest_path", restore_path(F.col("manifest_path"), location))
    lists = {}
    for s in document["abstracted_metadata"]["snapshots"]:
        if s.get("manifest-list"):
            lists[s["snapshot-id"]] = f"{location}/{s['manifest-list']}"
            rows = manifests.where(F.col("snapshot_id") == s["snapshot-id"]).select(*(c.split()[0] for c in MANIFEST_LIST.split(", ")))
            rows.coalesce(1).write.mode("overwrite").parquet(lists[s["snapshot-id"]])
    path = f"{location}/metadata/00001-{uuid.uuid4()}.metadata.json"
    store.write_json(path, restored_metadata(document["abstracted_metadata"], location, lists))
    catalog.register(db, table, location, path, overwrite=overwrite)
    store.delete(done)
    log.info("restored %s as %s.%s at %s: %d files", name, db, table, location, counts.copied)
    return Table(catalog, db, table)



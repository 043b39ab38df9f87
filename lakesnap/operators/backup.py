"""Backups: a table's reachable snapshots and files under one folder, with paths relative to the table.

`<root>/<name>/` gets `data/…` and `metadata/…` as in the table, `manifests` and `entries` (Parquet, paths relative),
`metadata.json` (relative), and, last, `backup_metadata.json`: a backup without it is not one.
"""

from __future__ import annotations

import copy
import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesnap import logs
from lakesnap.errors import Conflict, CopyFailed, NotFound
from lakesnap.functions.paths import abstract_path, canonical, canonical_text
from lakesnap.operators.ancestry import chain
from lakesnap.operators.copying import copied, judged
from lakesnap.operators.manifests import abstracted, live_files
from lakesnap.operators.table import Table
from lakesnap.schemas import ENTRY, MANIFEST_LIST
from lakesnap.sources.catalog import checked
from lakesnap.sources.documents import Store


def relative(path: str, location: str) -> str:
    """abstract_path() for one string."""
    p, base = canonical_text(path), canonical_text(location)
    return p[len(base) :].lstrip("/") if p == base or p.startswith(base + "/") else p


def abstract_metadata(metadata: dict[str, Any]) -> dict[str, Any]:
    """A copy without location and logs, with the current snapshot's ancestors only (all, if there is no such chain) and
    relative manifest lists. Other keys stay."""
    out, location = copy.deepcopy(metadata), metadata.get("location", "")
    kept = chain(out.get("snapshots") or [], out.get("current-snapshot-id") or None)
    for s in kept:
        if s.get("manifest-list"):
            s["manifest-list"] = relative(s["manifest-list"], location)
    known = {s["snapshot-id"] for s in kept}
    for s in kept:
        if s.get("parent-snapshot-id") is not None and s["parent-snapshot-id"] not in known:
            del s["parent-snapshot-id"]
    return out | {"location": "", "snapshots": kept, "snapshot-log": [], "metadata-log": []}


def gathered(table: Table, snapshots: list[dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(manifests with their snapshot_id, entries with their manifest_path) of snapshots; each manifest once."""
    spark = table.spark
    lists = [s["manifest-list"] for s in snapshots if s.get("manifest-list")]
    if not lists:
        return spark.createDataFrame([], f"snapshot_id bigint, {MANIFEST_LIST}"), spark.createDataFrame([], f"manifest_path string, {ENTRY}")
    names = spark.createDataFrame([(canonical_text(s["manifest-list"]), s["snapshot-id"]) for s in snapshots if s.get("manifest-list")], "__list string, snapshot_id bigint")
    rows = spark.read.schema(MANIFEST_LIST).parquet(*lists).withColumn("__file", canonical(F.col("_metadata.file_path")))
    rows = rows.withColumn("__list", F.regexp_replace("__file", "/[^/]*$", "")).join(F.broadcast(names), "__list").drop("__list", "__file")
    paths = [r.manifest_path for r in rows.select("manifest_path").distinct().collect()]
    entries = spark.read.schema(ENTRY).parquet(*paths).withColumn("manifest_path", F.regexp_replace(canonical(F.col("_metadata.file_path")), "/[^/]*$", ""))
    return rows.select("snapshot_id", *(c.split()[0] for c in MANIFEST_LIST.split(", "))), entries.select("manifest_path", *(c.split(" ")[0] for c in ("status int", "snapshot_id bigint", "data_file x")))


def backup(table: Table, root: str, name: str, *, since: str | None = None, max_failure_ratio: float = 0.0, overwrite: bool = False, options: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Copies the table under root/name; the backup's document. since: an earlier backup of the same root; what that
    (or those before it) holds is referred to, not copied. overwrite: the new backup is made beside the one of that name
    and takes its place when it is whole; one that others refer to is not replaced."""
    name, store, spark = checked(name, "backup name"), Store(table.spark), table.spark
    root = store.qualified(root).rstrip("/")
    home, log = f"{root}/{name}", logs.get("backup")
    if store.exists(f"{home}/backup_metadata.json"):
        if not overwrite:
            raise Conflict(f"backup {name} exists")
        if (others := referring(store, root, name)) or since == name:
            raise Conflict(f"backup {name} holds files of {', '.join(others) or name}")
    at = f"{root}/.{name}-{uuid.uuid4().hex}"
    metadata = table.metadata()
    location, relative_metadata = metadata["location"], abstract_metadata(metadata)
    snapshots = chain(metadata["snapshots"], metadata["current-snapshot-id"] or None)
    manifests, entries = gathered(table, snapshots)
    # a file that a later manifest deletes is still read by the snapshots before it
    files = live_files(entries).select("content", "file_path", F.col("file_size_in_bytes").alias("size"), "record_count")
    files = files.withColumn("path", abstract_path(F.col("file_path"), location)).withColumn("home", F.lit(home))
    if since is not None:
        held = held_files(spark, f"{root}/{checked(since, 'backup name')}")
        files = files.drop("home").join(held, "path", "left").withColumn("home", F.coalesce("home", F.lit(home)))
    files.write.mode("overwrite").parquet(f"{at}/files")
    files = spark.read.parquet(f"{at}/files")
    plan = files.where(F.col("home") == home).select(F.col("file_path").alias("src"), F.concat_ws("/", F.lit(at), "path").alias("dst"), "size")
    copied(plan, options=options).write.mode("overwrite").parquet(f"{at}/outcomes")
    try:
        counts = judged(spark.read.parquet(f"{at}/outcomes"), max_failure_ratio)
    except CopyFailed:
        store.delete(at)
        raise
    manifests.withColumn("manifest_path", abstract_path(F.col("manifest_path"), location)).coalesce(1).write.mode("overwrite").parquet(f"{at}/manifests")
    abstracted(entries, location).withColumn("manifest_path", abstract_path(F.col("manifest_path"), location)).write.mode("overwrite").parquet(f"{at}/entries")
    store.write_json(f"{at}/metadata.json", relative_metadata, overwrite=True)
    document = {
        "original_database": table.db, "original_table": table.name, "original_location": location, "backup_name": name, "abstracted_metadata": relative_metadata,
        "manifest_lists": [s["manifest-list"] for s in relative_metadata["snapshots"] if s.get("manifest-list")],
        "individual_manifests": [r.manifest_path for r in spark.read.parquet(f"{at}/manifests").select("manifest_path").distinct().orderBy("manifest_path").collect()],
        "data_files_table": "files", "copied": counts.copied, "failed": counts.failed, "since": since, "created_ms": int(time.time() * 1000),
    }
    store.write_json(f"{at}/backup_metadata.json", document)
    store.replace(at, home)
    log.info("backup %s of %s.%s: %d files copied, %d failed", name, table.db, table.name, counts.copied, counts.failed)
    return document


def held_files(spark, home: str) -> DataFrame:
    """path, home (of the backup that holds the bytes) of the files of a backup."""
    return spark.read.parquet(f"{home}/files").select("path", "home").distinct()


def opened(store: Store, root: str, name: str) -> dict[str, Any]:
    """A backup's document; older ones name their manifest lists `manifest_files`."""
    try:
        out = store.read_json(f"{root.rstrip('/')}/{checked(name, 'backup name')}/backup_metadata.json")
    except NotFound:
        raise NotFound(f"backup {name}") from None
    return {**out, "manifest_lists": out.get("manifest_lists") or out.get("manifest_files") or []}


def backups(store: Store, root: str) -> list[str]:
    """Names of the finished backups under root."""
    return [x for x in store.names(root) if not x.startswith(".") and store.exists(f"{root.rstrip('/')}/{x}/backup_metadata.json")]


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, change ('added' or 'removed') between two lists of files (path)."""
    a, b = now.select("path").distinct(), before.select("path").distinct()
    return a.join(b, "path", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "path", "left_anti").withColumn("change", F.lit("removed")))


def _since(store: Store, root: str, name: str) -> list[str]:
    """The backups that a backup rests on, nearest first."""
    out, now = [], opened(store, root, name).get("since")
    while now and now not in out:
        out.append(now)
        now = opened(store, root, now).get("since")
    return out


def referring(store: Store, root: str, name: str) -> list[str]:
    """Backups that rest on this one."""
    return [x for x in backups(store, root) if x != name and name in _since(store, root, x)]


def expire_backups(store: Store, root: str, keep: int) -> list[str]:
    """Deletes all but the last `keep` backups by time, except those that a kept one rests on; the names deleted."""
    names = sorted(backups(store, root), key=lambda x: (opened(store, root, x).get("created_ms", 0), x))
    stay = set(names[-max(1, keep) :])
    stay |= {y for x in stay for y in _since(store, root, x)}
    gone = [n for n in names if n not in stay]
    for n in gone:
        store.delete(f"{root.rstrip('/')}/{n}")
    return gone

"""Manifests as DataFrames: flattened, relocated, patched, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesnap.functions.paths import abstract_path, canonical, relocate, relocate_bounds


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the least order: a partial aggregate, no window."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *others)).alias("__first")).select(key, f"__first.{order}", *(f"__first.{c}" for c in others))


def live_files(entries: DataFrame, content: int | None = None) -> DataFrame:
    """Distinct files of entries that are not deleted; files without a path are left out."""
    files = entries.where("status <> 2 and data_file.file_path is not null")
    files = files if content is None else files.where(F.col("data_file.content") == content)
    return files.select("data_file.*").dropDuplicates(["file_path"])


def data_only(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """Files that are not among deletes (file_path)."""
    return files.join(deletes.select("file_path").distinct(), "file_path", "left_anti")


def delete_manifests(lists: DataFrame) -> DataFrame:
    return lists.where("content = 1 and manifest_path is not null")


def in_delete_manifests(manifests: DataFrame, lists: DataFrame) -> DataFrame:
    """Manifests (manifest_path) that a list names as delete manifests; whole paths are compared."""
    return manifests.join(delete_manifests(lists).select("manifest_path").distinct(), "manifest_path", "left_semi")


def moved(entries: DataFrame, change: Column | None = None, old: str = "", new: str = "") -> DataFrame:
    """Entries with data_file.file_path and text bounds moved from old to new (or file_path changed as given)."""
    f = F.col("data_file")
    path = relocate(f["file_path"], old, new) if change is None else change
    out = f.withField("file_path", path)
    for b in ("lower_bounds", "upper_bounds"):
        out = out.withField(b, relocate_bounds(f[b], old, new)) if change is None else out
    return entries.withColumn("data_file", out)


def abstracted(entries: DataFrame, location: str) -> DataFrame:
    return moved(entries, abstract_path(F.col("data_file.file_path"), location))


def patched_sizes(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries whose file is in sizes (file_path, size) get that size and lose their statistics, which no longer hold."""
    s = sizes.select(F.col("file_path").alias("__path"), F.col("size").alias("__size"))
    joined = entries.join(s, entries["data_file.file_path"] == s["__path"], "left")
    f, hit = F.col("data_file"), F.col("__size").isNotNull()
    out = f.withField("file_size_in_bytes", F.coalesce("__size", f["file_size_in_bytes"]))
    for c in ("value_counts", "null_value_counts", "lower_bounds", "upper_bounds"):
        out = out.withField(c, F.when(~hit, f[c]))
    return joined.withColumn("data_file", out).drop("__path", "__size")

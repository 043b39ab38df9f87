"""Avro manifests and manifest lists of other tools: read as DataFrames, and rewritten file by file on executors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lakesnap.functions.paths import canonical_text
from lakesnap.operators.copying import filesystem
from lakesnap.sources import avro

LIST_ROW = "source string, manifest_path string, manifest_length bigint, content int, added_snapshot_id bigint"
FILE_ROW = "source string, status int, snapshot_id bigint, content int, file_path string, file_format string, record_count bigint, file_size_in_bytes bigint"
#: The fields of a data file that hold only for its old bytes.
STATISTICS = ("column_sizes", "value_counts", "null_value_counts", "nan_value_counts", "lower_bounds", "upper_bounds")


def _read(spark: SparkSession, paths: list[str], schema: str, row) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            out = [row(path, r) for path, data in zip(pdf.path, pdf.content, strict=True) for r in avro.decode(data)[0]]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({n: "Int64" for n, c in zip(names, schema.split(", "), strict=True) if c.endswith("int")})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, schema)


def read_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """LIST_ROW for each manifest that the lists name."""
    return _read(spark, paths, LIST_ROW, lambda p, r: (p, r["manifest_path"], r.get("manifest_length"), r.get("content", 0), r.get("added_snapshot_id")))


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FILE_ROW for each entry; entries without a file are left out by `where file_path is not null`."""

    def row(path: str, r: dict[str, Any]) -> tuple:
        f = r.get("data_file") or {}
        return path, r.get("status"), r.get("snapshot_id"), f.get("content", 0), f.get("file_path"), f.get("file_format"), f.get("record_count"), f.get("file_size_in_bytes")

    return _read(spark, paths, FILE_ROW, row)


def _moved(path: str, old: str, new: str) -> str:
    c = canonical_text(path)
    return new + c[len(old) :] if c == old or c.startswith(old + "/") else path


def _moved_bound(value: bytes, old: str, new: str) -> bytes:
    try:
        text = value.decode()
    except UnicodeDecodeError:
        return value
    return (new + text[len(old) :]).encode() if text == old or text.startswith(old + "/") else value


def rewrite(data: bytes, old: str, new: str, sizes: dict[str, int] | None = None) -> bytes:
    """A manifest or manifest list with paths moved from old to new. Files in sizes (by new path) get that size and lose
    their statistics. Header metadata stays; data that names nothing under old comes back as it is."""
    old, new = canonical_text(old), canonical_text(new)
    rows, schema, meta = avro.decode(data)
    before = repr(rows)
    for r in rows:
        if r.get("manifest_path"):
            r["manifest_path"] = _moved(r["manifest_path"], old, new)
        f = r.get("data_file")
        if not f or not f.get("file_path"):
            continue
        f["file_path"] = _moved(f["file_path"], old, new)
        for name in ("lower_bounds", "upper_bounds"):
            for b in f.get(name) or []:
                b["value"] = _moved_bound(b["value"], old, new)
        if sizes and f["file_path"] in sizes:
            f["file_size_in_bytes"] = sizes[f["file_path"]]
            f.update({k: None for k in STATISTICS if k in f})
    return data if repr(rows) == before else avro.encode(rows, schema, meta, meta.get("avro.codec", b"null").decode())


def rewritten(plan: DataFrame, old: str, new: str) -> DataFrame:
    """manifest_path (dst) and manifest_length of each manifest of plan (src, dst, sizes map<string,bigint> or null)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, dst, sizes in zip(pdf.src, pdf.dst, pdf.sizes, strict=True):
                (a, p), (b, q) = filesystem(src), filesystem(dst)
                with a.open_input_stream(p) as f:
                    data = rewrite(f.read(), old, new, dict(sizes) if sizes is not None else None)
                b.create_dir(q.rsplit("/", 1)[0], recursive=True)
                with b.open_output_stream(q) as f:
                    f.write(data)
                out.append(len(data))
            yield pd.DataFrame({"manifest_path": pdf.dst, "manifest_length": out})

    return plan.select("src", "dst", "sizes").mapInPandas(work, "manifest_path string, manifest_length bigint")

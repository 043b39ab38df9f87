"""The chain of snapshots that led to the current one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain(snapshots: list[dict[str, Any]], current: int | None) -> list[dict[str, Any]]:
    """Oldest first. A missing parent ends it, a cycle too. Without a current id, or if that is unknown: all snapshots."""
    by_id = {s["snapshot-id"]: s for s in snapshots}
    out, seen, at = [], set(), current
    while at is not None and at in by_id and at not in seen:
        seen.add(at)
        out.append(by_id[at])
        at = by_id[at].get("parent-snapshot-id")
    return out[::-1] or list(snapshots)


def ancestry(nodes: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, parent, depth (0: the start) for nodes (id, parent) on the way from each start (id) to its root.

    One recursive query; depth bounds it, so a cycle ends in an error rather than never."""
    spark = nodes.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE up(id, parent, depth) MAX RECURSION LEVEL {int(depth) + 1} AS (
              SELECT n.id, n.parent, 0 FROM {{nodes}} n JOIN {{start}} s ON n.id = s.id
              UNION ALL
              SELECT n.id, n.parent, up.depth + 1 FROM {{nodes}} n JOIN up ON n.id = up.parent)
            SELECT id, parent, depth FROM up""",
        nodes=nodes, start=start,
    )


def oldest_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("depth").desc())

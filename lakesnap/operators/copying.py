"""Byte copies on executors: a plan of (src, dst, size) becomes outcomes, one row for each file."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lakesnap.errors import CopyFailed
from lakesnap.schemas import OUTCOME

#: Bytes that one task copies, about; files of unknown size count as this much.
TASK_BYTES, UNKNOWN = 1 << 30, 64 << 20


def filesystem(uri: str, options: Mapping[str, str] | None = None):
    """(pyarrow file system, path in it). options: those of an S3 store that isn't the default one (Config.s3_options)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    if options and uri.startswith("s3://"):
        return fs.S3FileSystem(**options), uri[5:]
    return fs.FileSystem.from_uri(uri)


def copy_file(src: str, dst: str, attempts: int = 3, delay: float = 1.0, options: Mapping[str, str] | None = None) -> tuple[bool, int | None, int, str | None]:
    """ok, size, attempts, error. A store copies within itself where it can."""
    import time

    from pyarrow import fs

    for n in range(1, attempts + 1):
        try:
            (a, p), (b, q) = filesystem(src, options), filesystem(dst, options)
            info = a.get_file_info(p)
            if info.type != fs.FileType.File:
                return False, None, n, f"no such file: {src}"
            b.create_dir(q.rsplit("/", 1)[0], recursive=True)
            fs.copy_files(p, q, source_filesystem=a, destination_filesystem=b)
            if (size := b.get_file_info(q).size) != info.size:
                raise OSError(f"{size} of {info.size} bytes arrived")
            return True, info.size, n, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                time.sleep(delay * 2 ** (n - 1))
    return False, None, attempts, error


def copied(plan: DataFrame, attempts: int = 3, delay: float = 1.0, options: Mapping[str, str] | None = None) -> DataFrame:
    """OUTCOME of each row of plan (src, dst, size or null). Files are spread over tasks by number and size; a task that
    is run again copies again, to the same places."""
    total = plan.agg(F.sum(F.coalesce("size", F.lit(UNKNOWN))), F.count("*")).first()
    tasks = max(1, min(total[1], max(-(-(total[0] or 0) // TASK_BYTES), plan.sparkSession.sparkContext.defaultParallelism)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, d, *copy_file(s, d, attempts, delay, options)) for s, d in zip(pdf.src, pdf.dst, strict=True)]
            out = pd.DataFrame(rows, columns=["src", "dst", "ok", "size", "attempts", "err"])
            yield out.assign(size=out["size"].astype("Int64"))

    return plan.select("src", "dst").repartition(tasks).mapInPandas(work, OUTCOME)


def tally(outcomes: DataFrame) -> DataFrame:
    """copied, failed and the first five failures."""
    bad = F.slice(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.concat_ws(": ", "src", "err")))), 1, 5)
    return outcomes.agg(F.count_if("ok").alias("copied"), F.count_if(~F.col("ok")).alias("failed"), bad.alias("first_failures"))


def judged(outcomes: DataFrame, max_failure_ratio: float = 0.0) -> Row:
    """The tally, or CopyFailed if failed > ratio x all (0: any failure; 0.5: a majority, a tie passes)."""
    counts = outcomes.agg(F.count_if("ok").alias("copied"), F.count_if(~F.col("ok")).alias("failed")).first()
    if counts.failed > max_failure_ratio * (counts.copied + counts.failed):
        some = [f"{r.src}: {r.err}" for r in outcomes.where("not ok").orderBy("src").limit(5).collect()]
        more = counts.failed - len(some)
        raise CopyFailed("; ".join(some) + (f"; and {more} more" if more else ""))
    return counts

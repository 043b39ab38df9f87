"""Position deletes: written, relocated file by file, and applied."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesnap.functions.paths import canonical, canonical_text
from lakesnap.operators.copying import filesystem
from lakesnap.schemas import FIELD_IDS


#: Deletes that Spark may broadcast, through the driver, if it takes their files for small enough, and bytes of one in
#: memory, about; in its file it takes next to nothing (a path that repeats, positions in order).
BROADCAST, DELETE_BYTES = 50_000, 600

#: Rows of a delete file that are in memory at once, and of a row group, when it is rewritten.
BATCH = 1 << 17


def with_ids(deletes: DataFrame) -> DataFrame:
    """file_path and pos with the field ids that Parquet readers of table formats look for."""
    return deletes.select(*(F.col(c).alias(c, metadata={"parquet.field.id": i}) for c, i in FIELD_IDS.items()))


def applied(rows: DataFrame, deletes: DataFrame, path: str = "__path", pos: str = "__pos", n: int | None = None) -> DataFrame:
    """rows without those that deletes name by file and position. n: number of deletes, if it is known. If it isn't, is
    over BROADCAST or takes more memory than the session lets tables take that are broadcast, both sides are shuffled and
    sorted: no process holds all deletes."""
    d = deletes.select(canonical(F.col("file_path")).alias("__d_path"), F.col("pos").alias("__d_pos"))
    most = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if n is None or n > BROADCAST or n * DELETE_BYTES > most:
        d = d.hint("merge")
    return rows.join(d, (F.col(path) == F.col("__d_path")) & (F.col(pos) == F.col("__d_pos")), "left_anti")


def rewrite_file(src: str, dst: str, old: str, new: str, options: Mapping[str, str] | None = None) -> int:
    """Rewrites one delete file with paths moved from old to new, by columns; schema and field ids stay. -> new size.
    A file without file_path is copied as it is. Rows pass in batches: the paths of a whole file, which repeat, take next
    to nothing there, but hundreds of bytes a row in memory."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    (a, p), (b, q) = filesystem(src, options), filesystem(dst, options)
    b.create_dir(q.rsplit("/", 1)[0], recursive=True)
    with a.open_input_file(p) as file:
        deletes = pq.ParquetFile(file)
        schema = deletes.schema_arrow
        at = schema.get_field_index("file_path")
        repeat = ["file_path"] if at >= 0 else True  # positions don't
        with pq.ParquetWriter(q, schema, filesystem=b, compression="zstd", version="2.6", use_dictionary=repeat) as out:
            for batch in deletes.iter_batches(batch_size=BATCH):
                if at >= 0:
                    distinct = batch.column(at).unique().to_pylist()  # a file deletes from few files
                    moved = []
                    for x in distinct:
                        c = canonical_text(x) if x is not None else None
                        under = c is not None and (c == old or c.startswith(old + "/"))
                        moved.append(new + c[len(old) :] if under else x)
                    codes = pc.index_in(batch.column(at), value_set=pa.array(distinct, pa.string()))
                    batch = batch.set_column(at, schema.field(at), pa.array(moved, pa.string()).take(codes))
                out.write_batch(batch)
    return b.get_file_info(q).size


def rewritten(spark: SparkSession, plan: DataFrame, old: str, new: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """file_path (dst) and size for each delete file of plan (src, dst), rewritten on executors. Any failure is an error."""
    old, new = canonical_text(old), canonical_text(new)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_path": pdf.dst, "size": [rewrite_file(s, d, old, new, options) for s, d in zip(pdf.src, pdf.dst, strict=True)]})

    return plan.select("src", "dst").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(work, "file_path string, size long")

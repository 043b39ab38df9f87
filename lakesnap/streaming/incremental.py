"""Incremental copies: a file stream that copies what is new since the last run, and then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesnap.operators.copying import copied, judged
from lakesnap.functions.paths import abstract_path, canonical_text, restore_path


def sync(spark: SparkSession, source: str, target: str, state: str, pattern: str = "*.parquet") -> None:
    """Copies new files under source to the same places under target; `state` remembers what has been copied. Each
    batch's outcomes are kept at state/outcomes. A batch that fails is done again by the next run."""
    source = canonical_text(source)
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(source).select("path", "length")
    )  # fmt: skip  # content is never read: the reader prunes it

    def batch(rows: DataFrame, epoch: int) -> None:
        plan = rows.select(F.col("path").alias("src"), restore_path(abstract_path(F.col("path"), source), target).alias("dst"), F.col("length").alias("size"))
        out = f"{state}/outcomes/{epoch}"
        copied(plan).write.mode("overwrite").parquet(out)
        judged(spark.read.parquet(out))

    files.writeStream.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()

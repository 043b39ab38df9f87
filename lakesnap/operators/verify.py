"""Whether two tables hold the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesnap.errors import LakesnapError


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: missing and extra, the numbers of rows (with repeats) that only one side has. Rows are counted by a
    128-bit hash, so only hashes are shuffled, whatever the columns."""
    names = expected.columns
    if set(names) != set(actual.columns):
        raise LakesnapError(f"columns differ: {sorted(set(names) ^ set(actual.columns))}")

    def counted(df: DataFrame, sign: int) -> DataFrame:
        cols = [F.col(f"`{c}`") for c in names]
        return df.select(F.xxhash64(*cols).alias("x"), F.xxhash64(F.lit(1), F.to_json(F.struct(*cols))).alias("y"), F.lit(sign).alias("n"))

    n = counted(expected, 1).unionByName(counted(actual, -1)).groupBy("x", "y").agg(F.sum("n").alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).cast("bigint").alias("missing"), F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).cast("bigint").alias("extra"))


def verify(expected: DataFrame, actual: DataFrame) -> None:
    """An error unless rows, types and order of columns are equal."""
    if [(f.name, f.dataType) for f in expected.schema] != [(f.name, f.dataType) for f in actual.schema]:
        raise LakesnapError("schemas differ")
    r = difference(expected, actual).first()
    if r.missing or r.extra:
        raise LakesnapError(f"{r.missing} rows missing, {r.extra} extra")

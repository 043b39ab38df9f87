"""Shared folder, tables between steps, memory of Python workers, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that has none gets a
    new local folder; on a cluster, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lakesnap-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lakesnap/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """The tables that a run of an operator writes on its way. Leaving it takes them away, but for those that a result
    still reads (`result`)."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._tables = spark, [], []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self._paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df as a table whose files are dealt by key: joins on key read it without a shuffle, however often."""
        n, path, own = partitions(self.spark), scratch(self.spark, name), f"lakesnap_{name}_{uuid.uuid4().hex}"
        self._paths.append(path)
        self._tables.append(own)
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(own)
        return self.spark.table(own)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that stays."""
        return written(df, name)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        for own in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{own}`")
        for path in self._paths:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table of written() that no later step reads."""
    for name in df.inputFiles()[:1]:
        delete(spark, name.rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text) -> F.Column:
    """Words of the contracts: runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores after it as it takes to be none of columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes, not only the rows, of what a Python worker holds at a time: texts may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, BATCH_BYTES)


# -- memory of a Python worker, which Spark uses for one stage after another

_caches: list[tuple[str, weakref.ref]] = []
_owner = ""


class Cache(dict):
    """Emptied when another operator's work begins in this process."""

    def __init__(self, owner: str):
        super().__init__()
        _caches.append((owner, weakref.ref(self)))


class Memo(Cache):
    """Results that may be forgotten. About `limit` bytes are held, of entries of about `each`, in two halves: when the
    younger one is full, the older one goes, and what is asked for again comes back from it before that. memo[key] makes
    what is missing; keys longer than `largest` are not kept."""

    def __init__(self, owner: str, limit: int, make=None, largest: int | None = None, each: int = 180):
        super().__init__(owner)
        self.most, self.old, self.make, self.largest = limit // each // 2, {}, make, largest

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if self.largest is not None and len(key) > self.largest:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}


def claim(owner: str) -> None:
    """Work of an operator begins in this process: what other operators have kept here is dropped."""
    global _owner
    if _owner == owner:
        return
    _owner = owner
    for whose, ref in _caches:
        if whose != owner and (cache := ref()) is not None:
            cache.clear()
    _caches[:] = [x for x in _caches if x[1]() is not None]
    gc.collect()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)

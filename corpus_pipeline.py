"""The corpus pipeline: toxic documents out, near-duplicates out, secrets masked, sources mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesnap.llm.bpe import round_trip_column
from lakesnap.llm.common import remove, small_batches, table, unused, written
from lakesnap.llm.minhash import near_duplicates
from lakesnap.llm.mixing import mix, shuffled
from lakesnap.llm.queries import vocabulary
from lakesnap.llm.secrets import redact_column
from lakesnap.llm.toxicity import score_column, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The model is fitted on labelled rows of docs; null and empty texts are scored too."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(docs["text"], model) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id. Documents without words and rows
    without a doc_id stay; rows that repeat a doc_id are one document, of which the text of least hash stays."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one, (n,) = Window.partitionBy("doc_id").orderBy(F.xxhash64("text")), unused(docs.columns, "n")
    known = docs.join(kept, "doc_id", "left_semi").withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)
    return known.unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found masked, and n_chars to match. Null texts stay null, with their n_chars."""
    small_batches(spark)
    masked = docs.withColumn("text", redact_column(docs["text"]))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard, shuffled within each."""
    return shuffled(mix(docs)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 for each row; null texts count as empty."""
    small_batches(spark)
    found = docs.select("doc_id", "source", round_trip_column(docs["text"], vocabulary("word_bpe_49k.json")).alias("found"))
    return found.select("doc_id", "source", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]
#: No stage but the reading can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. What a stage has written goes as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
pipeline = pytest.importorskip("corpus_pipeline") if (Path(__file__).parents[2] / "corpus_pipeline.py").exists() else None

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1))
    odd = spark.createDataFrame([(10**6, None, "en", None, 0, 1), (10**6 + 1, "", "en", "src0", 0, 1), (10**6 + 2, "password = hunter2hunter2", "en", "src0", 25, 1), (None, "no id", "en", "src1", 5, 1)], docs.schema)
    now = docs.unionByName(odd)
    seen = {}
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        now.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now
        if name != "encoding":
            assert now.columns == docs.columns
    assert seen["toxicity"].count() <= docs.count() + 4 and seen["toxicity"].where("doc_id >= 1000000").count() == 3
    texts = seen["near_dedup"].where("text is not null and text <> ''")
    assert texts.count() == texts.select("text").distinct().count()
    assert seen["secrets"].where("doc_id = 1000002").first().text == "<secret>"
    assert seen["mixing"].groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2
    assert seen["encoding"].count() == seen["mixing"].count()
    for stage in (s for n, s in pipeline.STAGES if n != "toxicity"):
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and len(rows[0].ids_sha256) == len(hashlib.sha256().hexdigest())

import pytest
from pyspark.sql import functions as F

from lakesnap.functions import paths as P

LOCATION = "s3://bucket/warehouse/db/table"
ABSTRACT = [
    (f"{LOCATION}/metadata/snap-1.avro", LOCATION, "metadata/snap-1.avro"),
    ("metadata/snap-1.avro", LOCATION, "metadata/snap-1.avro"),
    (f"{LOCATION}/", f"{LOCATION}/", ""),
    (LOCATION, LOCATION, ""),
    (f"{LOCATION}2/x", LOCATION, f"{LOCATION}2/x"),
    ("s3a://bucket/t/x", "s3://bucket/t", "x"),
    ("s3://warehouse/t/data/x", "s3a://warehouse//t", "data/x"),
    ("file:/tmp/t/x", "file:///tmp/t", "x"),
    (None, LOCATION, None),
]


@pytest.mark.parametrize(("path", "location", "want"), ABSTRACT)
def test_abstract(spark, path, location, want):
    df = spark.createDataFrame([(path, location)], "p string, l string")
    assert df.select(P.abstract_path(df.p, df.l)).first()[0] == want


def test_loose_prefix(spark):
    df = spark.createDataFrame([("s3://b/t2/x",)], "p string")
    assert df.select(P.abstract_path(df.p, "s3://b/t", strict=False)).first()[0] == "2/x"
    assert df.select(P.relocate(df.p, "s3://b/t", "s3://c/u", strict=False)).first()[0] == "s3://c/u2/x"


@pytest.mark.parametrize("p", ["s3a://b//x/", "s3n://b/x", "file:///a//b", "file:/a/b/", "/a//b/", "a//b", "", "hdfs://h:80//a", "s3://b"])
def test_canonical_text_is_the_column(spark, p):
    df = spark.createDataFrame([(p,)], "p string")
    assert df.select(P.canonical(df.p)).first()[0] == P.canonical_text(p)


def test_restore_resolve_split(spark):
    df = spark.createDataFrame([("s3a://b/k/x", "/data/x")], "u string, r string")
    got = df.select(P.restore_path(df.r, "s3://new/t/"), P.resolve_path(df.u, "s3://q"), P.resolve_path(df.r, "s3://q/"), P.split_uri(df.u), P.split_uri(F.lit("s3://b")), P.split_uri(F.lit("http://x/y"))).first()
    assert got[0] == "s3://new/t/data/x" and got[1] == "s3://b/k/x" and got[2] == "s3://q/data/x"
    assert tuple(got[3]) == ("b", "k/x") and tuple(got[4]) == ("b", "") and got[5] is None
    with pytest.raises(Exception, match="no s3 URI"):
        df.select(P.split_uri(F.lit("http://x"), required=True)).collect()
    assert P.bucket_and_prefix("s3a://b/p/q/") == ("b", "p/q") and P.bucket_and_prefix("b/") == ("b", "") and P.bucket_and_prefix(" ") == ("", "")


def test_bounds(spark):
    values = [b"s3://old/t/data/x", b"s3://old/t", b"s3://old/t2", (7).to_bytes(4, "little"), b"\xff\xfes3://old/t/", b"plain", None]
    df = spark.createDataFrame([([(k, v) for k, v in enumerate(values)],)], "b array<struct<key:int,value:binary>>")
    got = [x.value and bytes(x.value) for x in df.select(P.relocate_bounds(df.b, "s3://old/t", "s3://new/u")).first()[0]]
    assert got == [b"s3://new/u/data/x", b"s3://new/u", *values[2:]]

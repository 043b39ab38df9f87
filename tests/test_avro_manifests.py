from lakesnap.sources import avro
from lakesnap.sources import avro_manifests as A

BOUND = {"type": "array", "items": {"type": "record", "name": "b", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}
MANIFEST = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [
    {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}, {"name": "lower_bounds", "type": ["null", BOUND]}]}}]}
LIST = {"type": "record", "name": "list", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "content", "type": "int"}]}


def entry(path, content=0, bound=b"\x07\x00\x00\x00"):
    return {"status": 1, "snapshot_id": 5, "data_file": {"content": content, "file_path": path, "file_format": "PARQUET", "record_count": 3, "file_size_in_bytes": 10, "lower_bounds": [{"key": 1, "value": bound}]}}


ROWS = [entry("s3://old/t/data/a"), entry("s3a://old/t/data/d", 1, b"s3://old/t/data/a"), entry("s3://old/t2/x", 0, b"\xffs3://old/t/")]


def test_rewrite():
    data = avro.encode(ROWS, MANIFEST, {"partition-spec-id": b"0"})
    back, schema, meta = avro.decode(A.rewrite(data, "s3://old/t", "s3://new/u", {"s3://new/u/data/d": 99}))
    a, d, x = (r["data_file"] for r in back)
    assert a["file_path"] == "s3://new/u/data/a" and a["lower_bounds"][0]["value"] == b"\x07\x00\x00\x00" and a["file_size_in_bytes"] == 10
    assert d["file_path"] == "s3://new/u/data/d" and d["file_size_in_bytes"] == 99 and d["lower_bounds"] is None
    assert x == ROWS[2]["data_file"] and schema == MANIFEST and meta["partition-spec-id"] == b"0"
    moved = avro.decode(A.rewrite(avro.encode(ROWS, MANIFEST), "s3://old/t", "s3://new/u"))[0]
    assert moved[1]["data_file"]["lower_bounds"][0]["value"] == b"s3://new/u/data/a"
    assert A.rewrite(data, "s3://none", "s3://new") == data
    lists = avro.decode(A.rewrite(avro.encode([{"manifest_path": "s3://old/t/m", "manifest_length": 4, "content": 1}], LIST), "s3://old/t", "s3://n"))[0]
    assert lists == [{"manifest_path": "s3://n/m", "manifest_length": 4, "content": 1}]


def test_files(spark, tmp_path):
    (tmp_path / "m.avro").write_bytes(avro.encode(ROWS, MANIFEST))
    (tmp_path / "l.avro").write_bytes(avro.encode([{"manifest_path": "s3://old/t/m", "manifest_length": 4, "content": 1}], LIST))
    got = A.read_manifests(spark, [str(tmp_path / "m.avro")]).orderBy("file_path").collect()
    assert [(r.content, r.file_path, r.record_count) for r in got] == [(0, "s3://old/t/data/a", 3), (0, "s3://old/t2/x", 3), (1, "s3a://old/t/data/d", 3)]
    assert A.read_lists(spark, [str(tmp_path / "l.avro")]).first().manifest_path == "s3://old/t/m"
    plan = spark.createDataFrame([(f"{tmp_path}/m.avro", f"{tmp_path}/out/m.avro", {"s3://n/data/d": 7}), (f"{tmp_path}/l.avro", f"{tmp_path}/out/l.avro", None)], "src string, dst string, sizes map<string,bigint>")
    done = {r.manifest_path: r.manifest_length for r in A.rewritten(plan, "s3://old/t", "s3://n").collect()}
    assert done == {p: (tmp_path / "out" / p.rsplit("/", 1)[1]).stat().st_size for p in done} and len(done) == 2
    assert {r.file_size_in_bytes for r in A.read_manifests(spark, [f"{tmp_path}/out/m.avro"]).collect()} == {10, 7}

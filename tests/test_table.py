import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakesnap import cli, logs
from lakesnap.config import Config, catalog_settings
from lakesnap.errors import Conflict, CopyFailed, LakesnapError, NotFound
from lakesnap.operators.ancestry import ancestry, chain, oldest_first
from lakesnap.operators.backup import abstract_metadata, backup, backups, expire_backups, opened
from lakesnap.operators.copying import copied, judged, tally
from lakesnap.operators.deletes import rewrite_file
from lakesnap.operators.restore import restore
from lakesnap.operators.table import Table
from lakesnap.operators.verify import difference, verify
from lakesnap.sources import avro
from lakesnap.sources.catalog import Catalog
from lakesnap.sources.documents import Store, retry
from lakesnap.streaming.incremental import sync

PEOPLE = [(1, "Alice", 100.5), (2, "Bob", 200.75), (3, "Charlie", None), (4, None, 400.0), (5, "Eve", 500.99)]
DDL = "id int, name string, value double"


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "warehouse"))


@pytest.fixture
def people(catalog):
    t = Table.create(catalog, "default", "people", DDL)
    t.insert(PEOPLE)
    return t


def ids(df):
    return sorted(r.id for r in df.collect())


def test_commits_and_time_travel(people):
    first = people.snapshot()["snapshot-id"]
    second = people.insert([(6, "F", 1.0)])
    people.delete_where("id in (1, 6)")
    people.delete_where("id = 2")
    assert ids(people.scan()) == [3, 4, 5]
    assert ids(people.scan(snapshot_id=first)) == [1, 2, 3, 4, 5]
    assert ids(people.scan(as_of_ms=people.snapshot(second)["timestamp-ms"])) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(NotFound):
        people.scan(snapshot_id=1)
    with pytest.raises(NotFound):
        people.scan(as_of_ms=1)
    people.overwrite(people.scan().limit(1))
    assert people.scan().count() == 1 and people.count().first()[0] == 1
    assert people.history().count() == 5 and people.snapshots().count() == 5
    assert people.latest_metadata().first().file == people.catalog.pointer("default", "people")["metadata_location"]
    assert len(people.expire(2)) == 3 and people.scan().count() == 1


def test_empty_table(catalog):
    t = Table.create(catalog, "default", "empty", DDL)
    assert t.scan().count() == 0 and t.files().count() == 0 and t.snapshot() is None
    backup(t, catalog.warehouse + "-b", "b")
    assert restore(catalog, catalog.warehouse + "-b", "b", "default", "again").scan().count() == 0


def test_merge(people, spark):
    people.merge(spark.createDataFrame([(2, "Robert"), (9, "New")], "id int, name string"), ["id"], insert=True)
    assert {r.id: (r.name, r.value) for r in people.scan().collect()}[2] == ("Robert", 200.75)
    assert ids(people.scan()) == [1, 2, 3, 4, 5, 9]
    with pytest.raises(Exception, match="several source rows"):
        people.merge(spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string"), ["id"])


def test_sql(people):
    got = people.catalog.sql("SELECT count(*) AS n, max(value) AS v FROM {p} WHERE id > 1", p="default.people").first()
    assert (got.n, got.v) == (4, 500.99)
    with pytest.raises(Exception, match="PARSE"):
        people.catalog.sql("SELEC 1")


def test_a_lost_race_is_a_conflict(people):
    before = people.catalog.pointer("default", "people")["metadata_location"]
    people.insert([(7, "x", 1.0)])
    with pytest.raises(Conflict):
        people._save(people.metadata(), before)


def test_no_commit_loses_a_snapshot(people):
    """A second writer commits after the first has read metadata, and again before the first moves the pointer."""
    first, second = people, Table(people.catalog, "default", "people")
    count = first.count().first()[0]

    def interleaved(m):  # the first writer has read m
        del first._snapshot
        second.insert([(8, "y", 1.0)])
        return Table._snapshot(m)

    first._snapshot = interleaved
    with pytest.raises(Conflict):
        first.insert([(9, "z", 1.0)])
    swap = people.catalog.swap

    def late(*args):
        people.catalog.swap = swap
        second.insert([(10, "w", 1.0)])
        swap(*args)  # the pointer goes back to the first writer's version

    people.catalog.swap = late
    first.insert([(11, "v", 1.0)])
    m = first.metadata()
    ids = {s["snapshot-id"] for s in m["snapshots"]}
    assert all(s.get("parent-snapshot-id") in ids | {None} for s in m["snapshots"])
    assert first.count().first()[0] == count + 3 and len(m["snapshots"]) == len(ids)
    first.insert([(12, "u", 1.0)])
    assert first.count().first()[0] == count + 4


def test_one_of_many_writers_creates_a_document(catalog, tmp_path):
    path = str(tmp_path / "one.json")

    def put(k):
        try:
            catalog.store.write_json(path, {"k": k})
            return k
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(put, range(16)) if k is not None]
    assert len(won) == 1 and catalog.store.read_json(path) == {"k": won[0]}


def test_backups_that_others_rest_on_stay(people, tmp_path):
    root = str(tmp_path / "backups")
    backup(people, root, "full")
    people.insert([(6, "F", 6.0)])
    backup(people, root, "b-later", since="full")
    backup(people, root, "a-last", since="b-later")
    with pytest.raises(Conflict):
        backup(people, root, "full", overwrite=True)
    assert expire_backups(people.store, root, 1) == []
    verify(people.scan(), restore(people.catalog, root, "a-last", "other", "again", str(tmp_path / "again")).scan())
    people.delete_where("id = 6")
    backup(people, root, "a-last", overwrite=True)
    assert backups(people.store, root) == ["a-last", "b-later", "full"]
    verify(people.scan(), restore(people.catalog, root, "a-last", "other", "third", str(tmp_path / "third")).scan())
    assert expire_backups(people.store, root, 1) == ["full", "b-later"]


def test_files_are_skipped(catalog, spark):
    t = Table.create(catalog, "default", "days", "ts timestamp, name string", day_of="ts")
    t.append(spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,id) ts, concat('n', id) name FROM range(10)"))
    plan = t.scan(days=("2024-01-03", "2024-01-04"))
    assert len(plan.inputFiles()) == 2 and plan.count() == 2
    assert t.scan(between={"name": ("n7", "n9")}).count() >= 3 and len(t.scan(between={"name": ("n7", "n9")}).inputFiles()) == 3


def test_backup_and_restore(people, tmp_path, spark):
    root = str(tmp_path / "backups")
    people.insert([(6, "F", 6.0)])
    people.delete_where("id = 1")
    people.set_property("write.object-storage.path", "s3://old")
    backup(people, root, "one")
    t = restore(people.catalog, root, "one", "other", "copy", str(tmp_path / "elsewhere"))
    verify(people.scan(), t.scan())
    assert len(t.snapshots().collect()) == 3 and ids(t.scan(snapshot_id=people.snapshots().orderBy("timestamp-ms").first()[0])) == [1, 2, 3, 4, 5]
    assert t.metadata()["properties"]["write.object-storage.path"].endswith("elsewhere/data")
    people.catalog.drop_table("default", "people", purge=True)
    assert ids(t.scan()) == [2, 3, 4, 5, 6]  # nothing refers to the source
    deleted = t.files().where("content = 1").first()
    assert deleted.file_size_in_bytes == Path(deleted.file_path.removeprefix("file:")).stat().st_size
    assert all("elsewhere" in r.file_path for r in spark.read.parquet(deleted.file_path).collect())
    for r in t.manifests().collect():
        assert r.manifest_length == sum(p.stat().st_size for p in Path(r.manifest_path.removeprefix("file:")).glob("*.parquet"))
    with pytest.raises(Conflict):
        restore(people.catalog, root, "one", "other", "copy")
    with pytest.raises(NotFound, match="backup none"):
        restore(people.catalog, root, "none", "other", "x")
    with pytest.raises(NotFound, match="table default.people"):
        backup(people, root, "two")
    with pytest.raises(ValueError, match="backup name"):
        backup(t, root, "bad name\n")


def test_incremental_backup(people, tmp_path):
    root = str(tmp_path / "backups")
    backup(people, root, "a")
    people.insert([(6, "F", 6.0)])
    second = backup(people, root, "b", since="a")
    people.insert([(7, "G", 7.0)])
    backup(people, root, "c", since="b")
    assert second["copied"] < people.files().count()
    assert ids(restore(people.catalog, root, "c", "other", "copy").scan()) == [1, 2, 3, 4, 5, 6, 7]
    store = Store(people.spark)
    assert backups(store, root) == ["a", "b", "c"] and expire_backups(store, root, 1) == []
    backup(people, root, "d")
    assert expire_backups(store, root, 1) == ["a", "b", "c"]


def test_old_backup_document(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "backup_metadata.json").write_text(json.dumps({"manifest_files": ["metadata/a"]}))
    assert opened(Store(spark), str(tmp_path), "x")["manifest_lists"] == ["metadata/a"]


def snaps(*pairs):
    return [{"snapshot-id": a, **({"parent-snapshot-id": b} if b else {}), "timestamp-ms": a, "manifest-list": f"s3a://w/t/metadata/snap-{a}.avro"} for a, b in pairs]


@pytest.mark.parametrize(
    ("pairs", "current", "want"),
    [([(1, 0), (2, 1), (3, 2), (4, 3)], 4, [1, 2, 3, 4]), ([(1, 0)], 1, [1]), ([(1, 0), (2, 1), (3, 1), (4, 2)], 4, [1, 2, 4]), ([(1, 0), (2, 1)], None, [1, 2]), ([(1, 0), (2, 1)], -1, [1, 2]), ([(2, 1)], 2, [2]), ([(1, 2), (2, 1)], 2, [1, 2]), ([], 3, []), ([(k, k - 1) for k in range(1, 121)], 120, list(range(1, 121)))],
)
def test_ancestry(pairs, current, want):
    m = {"location": "s3://w//t", "snapshots": snaps(*pairs), "current-snapshot-id": current, "snapshot-log": [1], "metadata-log": [2], "other": {"x": 1}}
    out = abstract_metadata(m)
    assert [s["snapshot-id"] for s in out["snapshots"]] == want
    assert all(s["manifest-list"].startswith("metadata/") for s in out["snapshots"])
    assert (out["location"], out["snapshot-log"], out["metadata-log"], out["other"], out["current-snapshot-id"]) == ("", [], [], {"x": 1}, current)
    assert m["snapshots"] == snaps(*pairs) and [s["snapshot-id"] for s in chain(m["snapshots"], current)] == want


def test_ancestry_as_a_query(spark):
    nodes = spark.createDataFrame([(k, k - 1 or None) for k in range(1, 121)], "id bigint, parent bigint")
    start = spark.createDataFrame([(120,)], "id bigint")
    assert [r.id for r in oldest_first(ancestry(nodes, start, 121)).collect()] == list(range(1, 121))
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id bigint, parent bigint")
    with pytest.raises(Exception, match="RECURSION"):
        ancestry(loop, spark.createDataFrame([(1,)], "id bigint"), 5).collect()


def test_copy_policy(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    plan = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/out/a", 10), (f"{tmp_path}/none", f"{tmp_path}/out/b", None)], "src string, dst string, size bigint")
    out = copied(plan, attempts=2, delay=0.01).persist()
    r = tally(out).first()
    assert (r.copied, r.failed, len(r.first_failures)) == (1, 1, 1) and "no such file" in r.first_failures[0]
    assert judged(out, max_failure_ratio=0.5).failed == 1  # a tie passes
    with pytest.raises(CopyFailed, match="none"):
        judged(out)
    with pytest.raises(CopyFailed):
        judged(out.where("not ok"), max_failure_ratio=0.5)
    assert (tmp_path / "out" / "a").read_bytes() == b"x" * 10


def test_delete_files(spark, tmp_path, people):
    people.delete_where("id < 3")
    total = 0
    for r in people.files().where("content = 1").collect():
        rewrite_file(r.file_path, f"{tmp_path}/moved.parquet", people.metadata()["location"], "s3://new/t")
        t = pq.read_table(f"{tmp_path}/moved.parquet")
        assert all(x.startswith("s3://new/t/data/") for x in t["file_path"].to_pylist())
        assert t.schema.field("file_path").metadata[b"PARQUET:field_id"] == b"2147483546"
        total += len(t)
    assert total == 2
    spark.createDataFrame([("s3://o/t/x", 1), (None, 2), ("s3://o/t2/x", 3)], "file_path string, pos long").coalesce(1).write.parquet(f"{tmp_path}/d")
    src = next(Path(tmp_path / "d").glob("*.parquet"))
    rewrite_file(str(src), f"{tmp_path}/e.parquet", "s3://o/t", "s3://n")
    assert pq.read_table(f"{tmp_path}/e.parquet")["file_path"].to_pylist() == ["s3://n/x", None, "s3://o/t2/x"]
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/g")
    rewrite_file(str(next(Path(tmp_path / "g").glob("*.parquet"))), f"{tmp_path}/h.parquet", "a", "b")
    assert pq.read_table(f"{tmp_path}/h.parquet").column_names == ["id"]


def test_a_delete_file_is_rewritten_in_batches(tmp_path):
    n, path = 600_000, "s3://o/t/data/" + "x" * 200
    paths = pa.DictionaryArray.from_arrays(pa.array([k % 2 for k in range(n)], pa.int32()), [path, "s3://o/other"])
    field = pa.field("file_path", pa.string(), metadata={"PARQUET:field_id": "2147483546"})
    schema = pa.schema([field, pa.field("pos", pa.int64())])
    pq.write_table(pa.table([paths.cast(pa.string()), pa.array(range(n))], schema), f"{tmp_path}/a.parquet")
    whole, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        size = rewrite_file(f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet", "s3://o/t", "s3://new")
    finally:
        pa.set_memory_pool(whole)
    assert pool.max_memory() < 60 << 20  # paths alone are 70 MB
    assert size == (tmp_path / "b.parquet").stat().st_size
    t = pq.read_table(f"{tmp_path}/b.parquet")
    assert t["pos"].to_pylist() == list(range(n)) and t.schema.field("file_path").metadata[b"PARQUET:field_id"] == b"2147483546"
    assert t["file_path"].to_pylist() == [path.replace("s3://o/t", "s3://new"), "s3://o/other"] * (n // 2)
    pq.write_table(pa.table([[], []], schema), f"{tmp_path}/none.parquet")
    rewrite_file(f"{tmp_path}/none.parquet", f"{tmp_path}/c.parquet", "s3://o/t", "s3://new")
    assert pq.read_table(f"{tmp_path}/c.parquet").schema.names == ["file_path", "pos"]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_deletes_are_not_broadcast(catalog, spark):
    t = Table.create(catalog, "db", "many", "id bigint")
    t.append(spark.range(200_000))
    t.delete_where("id % 2 = 0")
    t.delete_where("id % 4 = 1")
    assert t.files().where("content = 1").agg(F.sum("file_size_in_bytes")).first()[0] < 10 << 20  # Spark would broadcast them
    df = t.scan()
    assert "BroadcastHashJoin" not in plan_of(df)
    assert ids(df) == list(range(3, 200_000, 4))


def test_deletes_that_take_more_memory_than_a_broadcast_may(catalog, spark):
    t = Table.create(catalog, "db", "some", "id bigint")
    t.append(spark.range(80_000))
    t.delete_where("id % 2 = 0")  # 40,000, over the 10 MB that Spark broadcasts by default
    df = t.scan()
    assert "BroadcastHashJoin" not in plan_of(df)
    assert ids(df) == list(range(1, 80_000, 2))
    few = Table.create(catalog, "db", "few", "id bigint")
    few.append(spark.range(80_000))
    few.delete_where("id < 100")
    df = few.scan()
    assert "BroadcastHashJoin" in plan_of(df)
    assert ids(df) == list(range(100, 80_000))


def test_many_deletes_of_a_restored_table(catalog, spark, tmp_path):
    t = Table.create(catalog, "db", "many", "id bigint")
    t.append(spark.range(120_000))
    t.delete_where("id % 2 = 0")
    backup(t, str(tmp_path / "backups"), "b")
    back = restore(catalog, str(tmp_path / "backups"), "b", "elsewhere", "many")
    assert sum(r.record_count for r in back.files().where("content = 1").collect()) == 60_000
    df = back.scan()
    assert "BroadcastHashJoin" not in plan_of(df)
    assert ids(df) == list(range(1, 120_000, 2))


def test_verify(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    verify(a, a.orderBy(F.desc("k")))
    assert tuple(difference(a, a.dropDuplicates()).first()) == (1, 0)
    with pytest.raises(LakesnapError, match="1 rows missing"):
        verify(a, a.limit(2).unionByName(a.limit(1)))
    with pytest.raises(LakesnapError, match="schemas"):
        verify(a, a.withColumn("k", F.col("k").cast("long")))


def test_avro():
    schema = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "f", "type": {"type": "record", "name": "d", "fields": [
        {"name": "path", "type": "string"}, {"name": "n", "type": ["null", "long"]}, {"name": "b", "type": {"type": "array", "items": {"type": "record", "name": "k", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}},
        {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "x", "type": {"type": "fixed", "name": "q", "size": 2}}, {"name": "s", "type": {"type": "enum", "name": "u", "symbols": ["A", "B"]}}, {"name": "o", "type": "boolean"}, {"name": "again", "type": ["null", "q"]}]}}]}
    rows = [{"status": k - 2, "f": {"path": "é" * k, "n": None if k % 2 else -(1 << 40) * k, "b": [{"key": k, "value": bytes([k, 255])}] * k, "m": {"a": 0.5} if k else {}, "x": b"zz", "s": "B", "o": k > 1, "again": b"yy"}} for k in range(5)]
    for codec in ("null", "deflate"):
        back, got, meta = avro.decode(avro.encode(rows, schema, {"content": b"deletes"}, codec))
        assert back == rows and got == schema and meta["content"] == b"deletes"
    assert avro.decode(avro.encode([], schema))[0] == []
    with pytest.raises(ValueError, match="not an Avro"):
        avro.decode(b"PAR1")


def test_catalog(catalog):
    catalog.create_database("d")
    catalog.create_database("d")
    assert catalog.databases() == ["d"] and catalog.list_tables("d").count() == 0 and not catalog.drop_table("d", "t")
    Table.create(catalog, "d", "t", DDL)
    Table.create(catalog, "d", "t", DDL)
    with pytest.raises(Conflict):
        Table.create(catalog, "d", "t", DDL, if_not_exists=False)
    assert {r.col_name for r in catalog.describe("d", "t").collect()} >= {"location", "metadata_location"}
    assert catalog.clean_database("d") == ["t"] and not catalog.exists("d", "t")
    for bad in ("", "a b", "a;b", "a\n"):
        with pytest.raises(ValueError):
            catalog.exists("d", bad) if bad != "a\n" else catalog.exists("d", "a\nb")


def test_retry_and_settings(spark):
    calls = []
    with pytest.raises(OSError):
        retry(lambda: calls.append(1) or (_ for _ in ()).throw(OSError("x")), delay=0.001)
    assert len(calls) == 3
    c = Config.from_env({"LAKESNAP_BACKUP_ROOT": "s3a://b/p/", "LAKESNAP_SESSION_TOKEN": "  ", "LAKESNAP_ACCESS_KEY": "a", "LAKESNAP_ENDPOINT": "http://e", "LAKESNAP_CATALOG_TYPE": "hive"})
    assert c.backup_bucket == ("b", "p") and "session_token" not in c.s3_options() and c.s3_options()["endpoint_override"] == "http://e"
    assert c.spark_options()["spark.sql.catalog.lakesnap.type"] == "hive"
    with pytest.raises(ValueError, match="catalog type"):
        Config(catalog_type="x").spark_options()
    assert catalog_settings(spark).count() >= 0


def test_logs(tmp_path, capsys):
    logs.setup("INFO", str(tmp_path / "log"))
    logs.setup("INFO", str(tmp_path / "log"))
    logs.get("x").info("once")
    logs.get("x").debug("never")
    assert (tmp_path / "log").read_text().count("once") == 1 and "never" not in (tmp_path / "log").read_text()
    assert logs.get("x") is logs.get("x")
    with pytest.raises(ValueError, match="log level"):
        logs.setup("LOUD")


def test_command_line(people, tmp_path):
    c = Config(backup_root=str(tmp_path / "b"), warehouse=people.catalog.warehouse)
    assert cli.main(["backup", "--database", "default", "--table", "people", "--backup-name", "n"], c) == 0
    assert cli.main(["restore", "--backup-name", "n", "--target-database", "default", "--target-table", "two"], c) == 0
    assert cli.main(["restore", "--backup-name", "n", "--target-database", "default", "--target-table", "two"], c) == 1
    assert cli.main(["backup", "--database", "default", "--table", "none", "--backup-name", "m"], c) == 1
    with pytest.raises(SystemExit):
        cli.main(["backup"], c)


def test_sync(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.range(k + 1).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    sync(spark, f"file:{tmp_path}/in", f"file:{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count() == 6
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    sync(spark, f"file:{tmp_path}/in", f"file:{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count() == 16
    assert spark.read.parquet(f"{tmp_path}/state/outcomes/1").count() == 1

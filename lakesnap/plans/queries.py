"""Queries over the engine's own operators, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesnap.functions import paths
from lakesnap.operators import manifests as M
from lakesnap.operators.ancestry import ancestry
from lakesnap.operators.backup import backup, changed_files, gathered
from lakesnap.operators.copying import copied
from lakesnap.operators.restore import restore
from lakesnap.operators.table import Table
from lakesnap.operators.verify import difference
from lakesnap.sources.catalog import Catalog
from lakesnap.sources.documents import Store
from lakesnap.sources.workspace import workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, day_of: str | None = None) -> Table:
    """A test table, committed to a catalog of its own."""
    rows = read(spark, sf_dir, name)
    t = Table.create(Catalog(spark, f"{workspace(spark)}/warehouse"), "db", name, rows.schema, day_of=day_of)
    t.append(rows)
    return t


def moved(t: Table, name: str = "nightly") -> Table:
    """The table, backed up and restored under another name and place."""
    root = f"{workspace(t.spark)}/backups"
    backup(t, root, name)
    return restore(t.catalog, root, name, "elsewhere", f"{t.name}_restored")


@query("SELECT * FROM orders")
def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "orders").scan().orderBy("o_orderkey")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS count FROM {t}" for t in ("nation", "orders", "part", "supplier")))
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(spark, sf_dir, t).count().select(F.lit(t).alias("table_name"), "count") for t in ("nation", "orders", "part", "supplier")]
    return functools.reduce(DataFrame.unionByName, parts)


for _t in ("nation", "orders", "lineitem", "events", "customer", "documents", "embeddings", "conversations"):
    query(f"SELECT * FROM {_t}", f"roundtrip_{_t}")(lambda spark, sf_dir, t=_t: moved(stored(spark, sf_dir, t)).scan())


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS extra")
def verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference(read(spark, sf_dir, "lineitem"), moved(stored(spark, sf_dir, "lineitem")).scan())


LOCATION = r"^[a-z]+://[^/?#]+"
CANON = r"""SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS loc,
  rtrim(regexp_extract(url, '^[a-z]+:') || '//' || regexp_replace(regexp_replace(url, '^[a-z]+:/+', ''), '/+', '/', 'g'), '/') AS c FROM pages"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", LOCATION, 0).alias("loc"))


@query(f"SELECT page_id, CASE WHEN c = loc OR starts_with(c, loc || '/') THEN ltrim(substr(c, length(loc) + 1), '/') ELSE c END AS path FROM ({CANON})")
def path_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select("page_id", paths.abstract_path(p.url, p.loc).alias("path"))


@query("SELECT page_id, 's3://new/base/' || ltrim(substr(url, length(regexp_extract(url, '^[a-z]+://[^/?#]+')) + 1), '/') AS path FROM pages")
def path_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select("page_id", paths.restore_path(F.substr(p.url, F.length(p.loc) + 1), "s3://new/base//").alias("path"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 2 THEN 's3://base/' || ltrim(k, '/') ELSE 's3://' || k END AS path
  FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS k FROM pages)""")
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_replace("url", "^[a-z]+://", "")
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.array(F.lit("s3a://"), F.lit("s3://"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")), k).alias("path"))
    return p.select("page_id", paths.resolve_path(p.path, "s3://base/").alias("path"))


@query("""SELECT page_id, split_part(k, '/', 1) AS bucket, CASE WHEN strpos(k, '/') > 0 THEN substr(k, strpos(k, '/') + 1) ELSE '' END AS key
  FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS k FROM pages)""")
def uri_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "s3a://").alias("uri"))
    return p.select("page_id", paths.split_uri(p.uri).alias("u")).select("page_id", "u.bucket", "u.key")


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 AND (c = loc OR starts_with(c, loc || '/')) THEN 's3://moved' || substr(c, length(loc) + 1) ELSE url END AS path FROM ({CANON})""")
def relocate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    old = F.when(p.page_id % 2 == 0, p.loc).otherwise(F.lit("https://nowhere"))
    return p.select("page_id", paths.relocate(p.url, old, "s3://moved").alias("path"))


@query("SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) - turn AS depth FROM conversations")
def snapshot_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    key = lambda turn: F.col("conv_id") * 100_000 + turn
    nodes = c.select(key(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("parent"))
    start = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(key(F.col("turn")).alias("id"))
    depth = c.agg(F.max("turn")).first()[0] or 0
    return ancestry(nodes, start, depth + 1).select((F.col("id") / 100_000).cast("bigint").alias("conv_id"), (F.col("id") % 100_000).alias("turn"), F.col("depth").cast("bigint").alias("depth"))


@query("""WITH RECURSIVE up AS (SELECT 24 AS id, 0 AS depth UNION ALL SELECT (id - 1) // 2, depth + 1 FROM up WHERE id > 0)
  SELECT id, n_name, depth FROM up JOIN nation ON id = n_nationkey""")
def ancestry_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 2).cast("int")).alias("parent"))
    found = ancestry(nodes, spark.sql("SELECT 24 AS id"), 25)
    return found.join(n, F.col("id") == F.col("n_nationkey")).select("id", "n_name", "depth")


@query("SELECT '00003' AS version, true AS is_current")
def latest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "region")
    t.append(read(spark, sf_dir, "region"))
    t.set_property("owner", "nobody")
    found = t.latest_metadata()
    return found.select(F.regexp_extract("file", r"/(\d+)-[^/]*$", 1).alias("version"), (F.col("file") == t.current()).alias("is_current"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def execute_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "nation")
    return t.catalog.sql("SELECT n_regionkey, count(*) AS n FROM {t} GROUP BY n_regionkey", t="db.nation")


@query("SELECT 1::BIGINT AS place, 2::BIGINT AS snapshots, true AS is_current_ancestor UNION ALL SELECT 2, 2, true")
def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "region")
    t.delete_where("r_regionkey = 0")
    h = t.history()
    before = h.select(F.col("snapshot_id").alias("parent"), F.lit(True).alias("known"))
    placed = h.join(before, h.parent_id == before.parent, "left").withColumn("place", F.when(F.col("known"), 2).otherwise(1).cast("bigint"))
    return placed.select("place", F.lit(t.snapshots().count()).alias("snapshots"), "is_current_ancestor")


MIDDLE = "TIMESTAMP '1995-06-01 00:00:00'"


@query(f"SELECT * FROM orders WHERE o_orderdate < {MIDDLE}")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    t = Table.create(Catalog(spark, f"{workspace(spark)}/warehouse"), "db", "orders", rows.schema)
    first = t.append(rows.where(f"o_orderdate < {MIDDLE}"))
    t.append(rows.where(f"o_orderdate >= {MIDDLE}"))
    return t.scan(snapshot_id=first)


@query("SELECT row_number() OVER (ORDER BY o_orderstatus) AS sequence, count(*) AS record_count FROM orders GROUP BY o_orderstatus")
def manifest_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    t = Table.create(Catalog(spark, f"{workspace(spark)}/warehouse"), "db", "orders", rows.schema)
    for status in "FOP":  # all that there are
        t.append(rows.where(F.col("o_orderstatus") == status))
    snapshots = t.snapshots().select(F.col("`snapshot-id`").alias("snapshot_id"), F.col("`sequence-number`").alias("sequence"))
    manifests, entries = gathered(t, t.metadata()["snapshots"])
    # each snapshot lists its own manifest and those before it; its files are those that it has added
    own = manifests.where("snapshot_id = added_snapshot_id").select("snapshot_id", "manifest_path").join(entries.drop("snapshot_id"), "manifest_path")
    return own.join(snapshots, "snapshot_id").groupBy("sequence").agg(F.sum("data_file.record_count").alias("record_count"))


@query("""SELECT p_brand, 's3://new/t/' || min(p_name) AS lower, 's3://new/t/' || max(p_name) AS upper, min(p_size) AS smallest FROM part GROUP BY p_brand""")
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("s3://old/t/"), "p_name")
    g = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(name).alias("a"), F.max(name).alias("b"), F.min("p_size").alias("s"))
    bound = lambda v: F.struct(F.lit(1).alias("key"), v.alias("value"))
    b = paths.relocate_bounds(F.array(bound(F.col("a").cast("binary")), bound(F.col("b").cast("binary")), bound(F.unhex(F.hex("s")))), "s3://old/t", "s3://new/t")
    g = g.select("p_brand", b.alias("v"))
    return g.select("p_brand", F.col("v")[0]["value"].cast("string").alias("lower"), F.col("v")[1]["value"].cast("string").alias("upper"), F.conv(F.hex(F.col("v")[2]["value"]), 16, 10).cast("int").alias("smallest"))


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_of_each(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def delete_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "orders")
    t.delete_where("o_orderstatus = 'F'")
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def delete_relocate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "orders")
    t.delete_where("o_orderstatus = 'F'")
    return moved(t).scan()


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def files_anti_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "doc_id", "source")
    deletes = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("file_path"))
    return M.data_only(files, deletes).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def delete_manifest_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("manifest_path"), "doc_id", "source")
    lists = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("manifest_path"), F.col("toxic").alias("content"))
    return M.in_delete_manifests(some, lists).select("doc_id", "source")


@query("SELECT d.doc_id, coalesce(l.quality + 1000, d.n_chars)::BIGINT AS size, l.doc_id IS NOT NULL AS patched FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def size_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    file = F.struct(F.col("doc_id").cast("string").alias("file_path"), F.col("n_chars").alias("file_size_in_bytes"), F.create_map(F.lit(0), F.lit(1)).alias("value_counts"), null("map<int,bigint>", "null_value_counts"), null("array<struct<key:int,value:binary>>", "lower_bounds"), null("array<struct<key:int,value:binary>>", "upper_bounds"))
    entries = read(spark, sf_dir, "documents").select("doc_id", file.alias("data_file"))
    sizes = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("q")).select(F.col("doc_id").cast("string").alias("file_path"), (F.col("q") + 1000).cast("bigint").alias("size"))
    return M.patched_sizes(entries, sizes).select("doc_id", F.col("data_file.file_size_in_bytes").alias("size"), F.col("data_file.value_counts").isNull().alias("patched"))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 0.5::DOUBLE ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "customer")
    t.merge(read(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select("c_custkey", (F.col("c_custkey") * 0.5).alias("c_acctbal")), ["c_custkey"])
    return t.scan()


@query("SELECT s_suppkey + CASE k WHEN 1 THEN 1000000 ELSE 0 END AS s_suppkey, CASE k WHEN 1 THEN 'new' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier, (VALUES (0), (1)) v(k) WHERE k = 0 OR s_suppkey % 2 = 0")
def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "supplier")
    new = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), F.lit("new").alias("s_name"), "s_nationkey", "s_acctbal")
    t.merge(new, ["s_suppkey"], insert=True)
    return t.scan()


@query("SELECT * FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) AND ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 3 DAY FROM events)")
def day_partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "events", day_of="ts")
    first = t.scan().agg(F.date_trunc("day", F.min("ts")).cast("date").alias("d")).select(F.date_add("d", 1).cast("string"), F.date_add("d", 2).cast("string")).first()
    low, high = first
    return t.scan(days=(low, high)).where(F.to_date("ts").between(low, high))


@query("SELECT count(DISTINCT s_suppkey % 4) AS copied, 1::BIGINT AS failed FROM supplier")
def copy_outcome_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = workspace(spark)
    rows = read(spark, sf_dir, "supplier").where("s_suppkey IS NOT NULL").withColumn("k", F.col("s_suppkey") % 4)
    # a file for each k: ranges would go by a sample, and may put two into one
    rows.repartition(4, "k").write.option("maxRecordsPerFile", 0).partitionBy("k").parquet(f"{place}/in")
    files = spark.read.schema(rows.schema).parquet(f"{place}/in").select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_size").alias("size")).distinct()
    missing = spark.createDataFrame([(f"{place}/in/none.parquet", None)], "src string, size bigint")
    plan = files.unionByName(missing).withColumn("dst", F.concat_ws("/", F.lit(f"{place}/out"), F.substring_index("src", "/", -2)))
    return copied(plan, attempts=1).agg(F.count_if("ok").alias("copied"), F.count_if(~F.col("ok")).alias("failed"))


@query("SELECT 'added' AS change, doc_id FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT 'removed', doc_id FROM labels WHERE toxic = 1 AND quality <> 1")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "labels").withColumn("path", F.col("doc_id").cast("string"))
    return changed_files(files.where("quality = 1"), files.where("toxic = 1")).select("change", F.col("path").cast("bigint").alias("doc_id"))


@query("SELECT * FROM (VALUES ('append'), ('delete'), ('merge'), ('append')) v(operation)")
def snapshots_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "nation")
    t.delete_where("n_regionkey = 1")
    t.merge(spark.sql("SELECT 3 AS n_nationkey, 'x' AS n_name"), ["n_nationkey"])
    t.append(read(spark, sf_dir, "nation").limit(1))
    return t.snapshots().select(F.col("summary.operation").alias("operation"))


@query("SELECT 25::BIGINT AS record_count, 0 AS content, '0' AS low, '24' AS high UNION ALL SELECT 5, 1, NULL, NULL")
def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "nation")
    t.delete_where("n_regionkey = 1")
    bound = lambda c: F.col(c)[0]["value"].cast("string").cast("int")
    g = t.files().groupBy("content").agg(F.sum("record_count").alias("record_count"), F.min(bound("lower_bounds")).cast("string").alias("low"), F.max(bound("upper_bounds")).cast("string").alias("high"))
    return g.select("record_count", "content", "low", "high")


@query("SELECT 'db' AS namespace, 'region' AS table_name")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "region")
    Table.create(t.catalog, "db", "gone", "id int")
    t.catalog.drop_table("db", "gone", purge=True)
    return t.catalog.list_tables("db")


@query("""SELECT 1 AS status, n_regionkey::BIGINT AS snapshot_id, CASE WHEN n_regionkey < 3 THEN 's3://new/t/' ELSE 's3://other/' END || n_name AS file_path,
  n_nationkey::BIGINT AS record_count, CASE WHEN n_name = 'FRANCE' THEN 7 ELSE 100 END::BIGINT AS file_size_in_bytes FROM nation""")
def avro_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as other tools write them, a file for each region, moved to another place and read back."""
    from lakesnap.sources import avro
    from lakesnap.sources.avro_manifests import read_manifests, rewritten

    file = {"type": "record", "name": "file", "fields": [
        {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"},
        {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"},
    ]}
    fields = [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "data_file", "type": file}]
    place, by_region = workspace(spark), {}
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        path = ("s3://old/t/" if r.n_regionkey < 3 else "s3://other/") + r.n_name
        entry = {"content": 0, "file_path": path, "file_format": "PARQUET", "record_count": r.n_nationkey, "file_size_in_bytes": 100}
        by_region.setdefault(r.n_regionkey, []).append({"status": 1, "snapshot_id": r.n_regionkey, "data_file": entry})
    store = Store(spark)
    plan = []
    for k, rows in by_region.items():
        store.write(f"{place}/in/{k}.avro", avro.encode(rows, {"type": "record", "name": "entry", "fields": fields}))
        plan.append((store.qualified(f"{place}/in/{k}.avro"), store.qualified(f"{place}/out/{k}.avro"), {"s3://new/t/FRANCE": 7}))
    done = rewritten(spark.createDataFrame(plan, "src string, dst string, sizes map<string,bigint>"), "s3://old/t", "s3://new/t")
    paths = [r.manifest_path for r in done.collect()]  # one for each region
    return read_manifests(spark, paths).select("status", "snapshot_id", "file_path", "record_count", "file_size_in_bytes")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

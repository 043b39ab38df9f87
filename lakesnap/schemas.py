"""Row shapes of metadata."""

BOUNDS = "array<struct<key int, value binary>>"
COUNTS = "map<int, bigint>"
DATA_FILE = (
    "struct<content int, file_path string, file_format string, partition string, record_count bigint, file_size_in_bytes bigint, "
    f"value_counts {COUNTS}, null_value_counts {COUNTS}, lower_bounds {BOUNDS}, upper_bounds {BOUNDS}>"
)
#: status: 0 existing, 1 added, 2 deleted; content of a file: 0 data, 1 position deletes.
ENTRY = f"status int, snapshot_id bigint, data_file {DATA_FILE}"
#: content: 0 data manifests, 1 delete manifests.
MANIFEST_LIST = "manifest_path string, manifest_length bigint, content int, added_snapshot_id bigint, added_files bigint"
SNAPSHOT = "`snapshot-id` bigint, `parent-snapshot-id` bigint, `timestamp-ms` bigint, `sequence-number` bigint, `manifest-list` string, summary map<string,string>"
POSITION_DELETE = "file_path string, pos bigint"
OUTCOME = "src string, dst string, ok boolean, size bigint, attempts int, err string"
#: Parquet field ids of position deletes, as public table formats give them.
FIELD_IDS = {"file_path": 2147483546, "pos": 2147483545}

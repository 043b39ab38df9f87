"""Settings from the environment, and the session and file system options that follow from them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakesnap.functions.paths import bucket_and_prefix


@dataclass(frozen=True)
class Config:
    backup_root: str = ""
    warehouse: str = ""
    catalog: str = "lakesnap"
    catalog_type: str = "file"  # file; hive and glue only set session options
    endpoint: str = ""
    region: str = "us-east-1"
    access_key: str = ""
    secret_key: str = ""
    session_token: str = ""
    path_style: bool = True
    metastore: str = ""
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """LAKESNAP_BACKUP_ROOT, LAKESNAP_WAREHOUSE, and so on; blank counts as unset."""
        env = os.environ if env is None else env
        given = {k: env.get(f"LAKESNAP_{k.upper()}", "").strip() for k in cls.__dataclass_fields__}
        out = {k: v for k, v in given.items() if v}
        if "path_style" in out:
            out["path_style"] = out["path_style"].lower() in ("1", "true", "yes")
        return cls(**out)

    @property
    def backup_bucket(self) -> tuple[str, str]:
        return bucket_and_prefix(self.backup_root)

    def s3_options(self) -> dict[str, str]:
        """Options of an S3 file system; endpoint and token only where they are set."""
        out = {"region": self.region, "access_key": self.access_key, "secret_key": self.secret_key}
        out |= {k: v for k, v in (("session_token", self.session_token), ("endpoint_override", self.endpoint)) if v.strip()}
        return out | ({"scheme": "http"} if self.endpoint.strip().startswith("http:") else {})

    def spark_options(self) -> dict[str, str]:
        a, out = "spark.hadoop.fs.s3a.", {"spark.sql.session.timeZone": "UTC"}
        if self.access_key:
            out |= {f"{a}access.key": self.access_key, f"{a}secret.key": self.secret_key, f"{a}path.style.access": str(self.path_style).lower()}
        if self.session_token.strip():
            out |= {f"{a}session.token": self.session_token, f"{a}aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"}
        if self.endpoint.strip():
            out[f"{a}endpoint"] = self.endpoint
        c = f"spark.sql.catalog.{self.catalog}"
        if self.catalog_type == "hive":
            out |= {f"{c}.type": "hive", f"{c}.uri": self.metastore}
        elif self.catalog_type == "glue":
            out |= {f"{c}.catalog-impl": "org.apache.iceberg.aws.glue.GlueCatalog", f"{c}.warehouse": self.warehouse}
        elif self.catalog_type != "file":
            raise ValueError(f"unknown catalog type {self.catalog_type!r}")
        return out

    def session(self) -> SparkSession:
        """The running session, or a new one with these options. Whoever calls owns it and stops it."""
        builder = SparkSession.builder.appName("lakesnap")
        for k, v in self.spark_options().items():
            builder = builder.config(k, v)
        return builder.getOrCreate()


def catalog_settings(spark: SparkSession) -> DataFrame:
    """key, value, problem of the session's catalog settings; problem names values that no catalog accepts."""
    rows = []
    for k, v in spark.sparkContext.getConf().getAll():
        if k.startswith("spark.sql.catalog."):
            bad = "type=glue is no catalog type; set catalog-impl" if k.endswith(".type") and v == "glue" else None
            rows.append((k, v, bad))
    return spark.createDataFrame(sorted(rows), "key string, value string, problem string")

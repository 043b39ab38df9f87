"""`python -m lakesnap.cli backup|restore …`; 0 if it worked, else 1."""

from __future__ import annotations

import argparse
import sys

from lakesnap import logs
from lakesnap.config import Config
from lakesnap.errors import LakesnapError
from lakesnap.operators.backup import backup
from lakesnap.operators.restore import restore
from lakesnap.operators.table import Table
from lakesnap.sources.catalog import Catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakesnap")
    sub = p.add_subparsers(dest="what", required=True)
    b, r = sub.add_parser("backup"), sub.add_parser("restore")
    b.add_argument("--database", required=True)
    b.add_argument("--table", required=True)
    b.add_argument("--since", help="an earlier backup whose files need no copy")
    r.add_argument("--target-database", required=True)
    r.add_argument("--target-table", required=True)
    r.add_argument("--target-location")
    for x in (b, r):
        x.add_argument("--backup-name", required=True)
        x.add_argument("--catalog")
        x.add_argument("--log-level", default="INFO")
        x.add_argument("--log-file")
    return p


def main(args: list[str] | None = None, config: Config | None = None) -> int:
    a = parser().parse_args(args)
    log = logs.setup(a.log_level, a.log_file)
    c = config or Config.from_env()
    try:
        spark = c.session()
        catalog = Catalog(spark, c.warehouse, a.catalog or c.catalog)
        options = c.s3_options() if c.endpoint.strip() or c.access_key else None
        if a.what == "backup":
            backup(Table(catalog, a.database, a.table), c.backup_root, a.backup_name, since=a.since, options=options)
        else:
            restore(catalog, c.backup_root, a.backup_name, a.target_database, a.target_table, a.target_location, options=options)
    except (LakesnapError, ValueError) as e:
        log.error("%s failed: %s", a.what, e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

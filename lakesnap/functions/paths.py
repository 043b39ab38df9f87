"""Paths as columns: canonical form, and the ways between absolute and relative.

Canonical: s3a and s3n become s3, `file:/x` and `file:///x` become `file:/x`, repeated slashes after the scheme become
one, and none is at the end. Prefixes match at path borders only; strict=False matches any prefix, and compares the
text as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    p = F.regexp_replace(path, r"^s3[an]://", "s3://")
    scheme = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.-]*:)?/*", 1)
    slashes = F.when(F.startswith(p, F.lit("file:/")), F.lit("/")).when(F.length(scheme) > 0, F.lit("//")).otherwise(F.lit("/"))
    rest = F.regexp_replace(F.regexp_replace(p, r"^([A-Za-z][A-Za-z0-9+.-]*:)?/+", ""), "/+", "/")
    rooted = F.regexp_like(p, F.lit(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/"))
    return F.rtrim(F.when(rooted, F.concat(scheme, slashes, rest)).otherwise(rest), F.lit("/"))


def canonical_text(path: str) -> str:
    """canonical() for one string."""
    p = re.sub(r"^s3[an]://", "s3://", path)
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)?(/+)", p)
    if not m:
        return re.sub("/+", "/", p).rstrip("/")
    scheme = m[1] or ""
    return (scheme + ("//" if scheme and scheme != "file:" else "/") + re.sub("/+", "/", p[m.end() :])).rstrip("/")


def _lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def abstract_path(path: Column, location: Column | str, strict: bool = True) -> Column:
    """path relative to location, if it lies there; else path. The location itself becomes ''."""
    p, base = F.rtrim(path, F.lit("/")), F.rtrim(_lit(location), F.lit("/"))
    if strict:
        p, base = canonical(path), canonical(_lit(location))
    inside = F.startswith(p, base) if not strict else (p == base) | F.startswith(p, F.concat(base, F.lit("/")))
    return F.when(inside, F.ltrim(F.substr(p, F.length(base) + 1), F.lit("/"))).otherwise(p)


def restore_path(relative: Column, location: Column | str) -> Column:
    return F.concat_ws("/", F.rtrim(_lit(location), F.lit("/")), F.ltrim(relative, F.lit("/")))


def resolve_path(path: Column, base: Column | str) -> Column:
    """Absolute s3 paths in one scheme; others under base."""
    return F.when(F.startswith(path, F.lit("s3a://")), F.concat(F.lit("s3://"), F.substr(path, F.lit(7)))).when(F.startswith(path, F.lit("s3://")), path).otherwise(restore_path(path, base))


def relocate(path: Column, old: Column | str, new: Column | str, strict: bool = True) -> Column:
    """path moved from old to new, if it lies there; null stays null."""
    p, a = (canonical(path), canonical(_lit(old))) if strict else (path, _lit(old))
    b = canonical(_lit(new)) if strict else _lit(new)
    inside = (p == a) | F.startswith(p, F.concat(a, F.lit("/"))) if strict else F.startswith(p, a)
    return F.when(inside, F.concat(b, F.substr(p, F.length(a) + 1))).otherwise(path)


def split_uri(uri: Column, required: bool = False) -> Column:
    """struct<bucket, key> of an s3, s3a or s3n URI; for others null, or an error if required."""
    m = F.regexp_like(uri, F.lit("^s3[an]?://"))
    rest = F.split(F.regexp_replace(uri, "^s3[an]?://", ""), "/", 2)
    found = F.struct(rest[0].alias("bucket"), F.coalesce(F.get(rest, F.lit(1)), F.lit("")).alias("key"))
    return F.when(m, found).otherwise(F.raise_error(F.concat(F.lit("no s3 URI: "), uri)) if required else F.lit(None))


def bucket_and_prefix(value: str) -> tuple[str, str]:
    """A bucket, or a URI of a bucket and a folder, as (bucket, prefix without slashes at the end)."""
    value = value.strip()
    if not value:
        return "", ""
    m = re.match(r"s3[an]?://([^/]*)/?(.*)", value)
    return (m[1], m[2].rstrip("/")) if m else (value.rstrip("/"), "")


def relocate_bounds(bounds: Column, old: str, new: str) -> Column:
    """array<struct<key, value>> whose values that are UTF-8 and a path under old are moved; all others stay as they are."""

    def one(b: Column) -> Column:
        text = F.when(F.is_valid_utf8(b["value"].cast("string")), b["value"].cast("string"))
        inside = (text == old) | F.startswith(text, F.lit(old.rstrip("/") + "/"))
        moved = F.concat(F.lit(new.rstrip("/")), F.substr(text, F.lit(len(old.rstrip("/")) + 1))).cast("binary")
        return F.struct(b["key"].alias("key"), F.when(inside, moved).otherwise(b["value"]).alias("value"))

    return F.transform(bounds, one)

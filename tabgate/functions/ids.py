"""Identifiers: file-id prefix and case, composite keys, name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabgate.functions.text import strip

# Prefix of registered file ids, shape of a UUID, namespace of URL-based UUIDs (RFC 4122).
FILE_ID_PREFIX = "dg.4DFC/"
UUID_SHAPE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def file_id_ok(value: Column, omit_prefix: Column) -> Column:
    low = F.lower(value)
    prefixed = low.startswith(FILE_ID_PREFIX.lower())
    tail = F.get(F.split(low, "/"), F.lit(1))
    return F.when(omit_prefix, ~prefixed & low.rlike(UUID_SHAPE)).otherwise(
        prefixed & F.coalesce(tail, F.lit("")).rlike(UUID_SHAPE)
    )


def file_id_case(value: Column) -> Column:
    """Lower case all over, except for the registered prefix."""
    low = F.lower(value)
    prefix = FILE_ID_PREFIX.lower()
    return F.when(
        low.startswith(prefix), F.concat(F.lit(FILE_ID_PREFIX), F.replace(low, F.lit(prefix), F.lit("")))
    ).otherwise(low)


def with_file_prefix(value: Column) -> Column:
    return F.when(value.startswith(FILE_ID_PREFIX), value).otherwise(
        F.concat(F.lit(FILE_ID_PREFIX), value)
    )


def composite_id(key_value: Column, parts: Column) -> Column:
    """The trimmed key, else the trimmed components joined by '_' (a lone '_' counts as nothing)."""
    given = F.nullif(strip(key_value), F.lit(""))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(strip(p), F.lit(""))), "_")
    return F.coalesce(given, F.when(joined == "_", F.lit("")).otherwise(joined))


def uuid5(namespace: Column, name: Column) -> Column:
    """RFC 4122 version 5 UUID of a name, from built-in hashing only."""
    digest = F.sha1(
        F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8"))
    )
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80))
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def stable_file_id(site: str, study_id: Column, path: Column) -> Column:
    """Prefix + UUID chain site address -> study -> file path."""
    site_id = uuid5(F.lit(URL_NAMESPACE), F.lit(site))
    return F.concat(F.lit(FILE_ID_PREFIX), uuid5(uuid5(site_id, study_id), path))

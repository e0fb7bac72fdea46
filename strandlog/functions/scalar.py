"""Names, ids, policies and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of URLs for name-based UUIDs (RFC 4122), as bytes in hexadecimal.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def topic_name_ok(name: Column) -> Column:
    """1 to 249 characters of [a-zA-Z0-9._-], but not . or .. ."""
    return name.rlike(r"\A[a-zA-Z0-9._-]{1,249}\z") & ~name.isin(".", "..")


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID of version 5, by SHA-1: no Python."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12))


def split_virtual(name: Column) -> Column:
    """struct(base, key) of base/key; key is null without a slash."""
    return F.struct(F.substring_index(name, "/", 1).alias("base"), F.when(F.instr(name, "/") > 0, F.regexp_replace(name, r"\A[^/]*/", "")).alias("key"))


def altered(value: Column, operation: Column, change: Column) -> Column:
    """A setting after SET, DELETE, APPEND or SUBTRACT; the last two work on comma lists without repeats."""
    own = F.filter(F.split(F.coalesce(value, F.lit("")), ","), lambda x: x != "")
    new = F.filter(F.split(change, ","), lambda x: x != "")
    return F.when(operation == "SET", change).when(operation == "APPEND", F.array_join(F.array_union(own, new), ",")).when(operation == "SUBTRACT", F.array_join(F.array_except(own, new), ",")).when(operation == "DELETE", F.lit(None)).otherwise(value)

"""Deterministic identities: name-based UUIDs and database identifiers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122 and the version-5 name prefixes of conversations and memories.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
CONVERSATION_PREFIX = "locomo:conv:"
SPEAKER_PREFIX = "locomo:"
MEMORY_PREFIX = "eval-pipeline:"


def uuid5(name: Column) -> Column:
    """UUID version 5 of a name in the URL namespace: SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def conversation_user_id(idx: Column) -> Column:
    return uuid5(F.concat(F.lit(CONVERSATION_PREFIX), idx.cast("string")))


def speaker_user_id(idx: Column, role: Column, name: Column) -> Column:
    return uuid5(F.concat(F.lit(SPEAKER_PREFIX), idx.cast("string"), F.lit(":"), F.lower(role), F.lit(":"), name))


def memory_id(user_id: Column, key: Column, text: Column) -> Column:
    """Primary key of a memory: its user and its key, or its text where the key is blank."""
    return uuid5(F.concat(F.lit(MEMORY_PREFIX), user_id, F.lit(":"), F.coalesce(F.nullif(F.trim(key), F.lit("")), text)))


def database_identifier(name: Column) -> Column:
    """Lower-case identifier of at most 63 characters; longer ones end in a hash."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"))
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.when(s == "", F.lit("locomo")).otherwise(s)
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("db_"), s)).otherwise(s)
    return F.when(F.length(s) > 63, F.concat(F.substring(s, 1, 54), F.lit("_"), F.substring(F.sha1(s), 1, 8))).otherwise(s)

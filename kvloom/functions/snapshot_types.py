"""Snapshot value types, expiry and length coding as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvloom.functions.constants import COMPRESSED_TYPES, PHASES, VALUE_CLASSES, VALUE_TYPES


def type_name(type_byte: Column) -> Column:
    """Name of a type byte; null for unknown bytes."""
    pairs = [F.lit(x) for kv in VALUE_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), type_byte.cast("int"))


def value_class(type_byte: Column) -> Column:
    """string, list, set, zset, hash, or other (streams, modules); null for unknown bytes."""
    c = F.when(~type_byte.isin(*VALUE_TYPES), F.lit(None))
    for name, members in VALUE_CLASSES.items():
        c = c.when(type_byte.isin(*members), name)
    return c.otherwise("other")


def is_compressed(type_byte: Column) -> Column:
    return type_byte.isin(*COMPRESSED_TYPES)


def ttl_ms(expire: Column, now: Column) -> Column:
    """Milliseconds to the expiry if it is ahead of now, else 0: expired and persistent keys alike."""
    return F.when(expire > now, F.unix_millis(expire) - F.unix_millis(now)).otherwise(F.lit(0).cast("long"))


def is_expired(expire: Column, now: Column) -> Column:
    return F.coalesce(expire <= now, F.lit(False))


def expire_from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def expire_from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s)


def length_code(n: Column) -> Column:
    """Length coding of snapshot strings: 1 byte below 64, 2 below 16384, else 0x80 and 4 bytes, big-endian."""
    code = (
        F.when(n < 64, F.lpad(F.hex(n), 2, "0"))
        .when(n < 16384, F.lpad(F.hex(n + F.lit(0x4000)), 4, "0"))
        .otherwise(F.concat(F.lit("80"), F.lpad(F.hex(n), 8, "0")))
    )
    return F.unhex(code)


def string_code(data: Column) -> Column:
    """A string as snapshots hold it."""
    b = data.cast("binary")
    return F.concat(length_code(F.octet_length(b).cast("long")), b)


def code_name(code: Column, names: tuple[str, ...]) -> Column:
    """Name of an enum code; unknown codes are the default, the first."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), code.cast("int")), F.lit(names[0]))


def name_code(name: Column, names: tuple[str, ...]) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in names]), name).cast("int") - 1, F.lit(0))


def phase_name(code: Column) -> Column:
    return code_name(code, PHASES)


def phase_code(name: Column) -> Column:
    return name_code(name, PHASES)

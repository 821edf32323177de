"""The library's functions for SQL text: temporary functions whose bodies Catalyst inlines, so that plans hold no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kvloom.functions.constants import SLOTS, VALUE_CLASSES, VALUE_TYPES
from kvloom.functions.hashing import FNV_LOW, FNV_OFFSET, MASK32, crc16_table

BYTES = "transform(if(octet_length({0}) > 0, sequence(1, octet_length({0})), array()), i -> ascii(substring(decode(cast({0} AS BINARY), 'ISO-8859-1'), i, 1)))"
_CRC = (
    "aggregate(" + BYTES.format("data") + ", 0, (crc, b) -> (shiftleft(crc, 8) & 65535) ^ element_at(array("
    + ", ".join(map(str, crc16_table())) + "), (shiftright(crc, 8) ^ b) + 1))"
)
_FNV = (
    f"aggregate({BYTES.format('data')}, named_struct('hi', {FNV_OFFSET >> 32}L, 'lo', {FNV_OFFSET & MASK32}L), (h, b) -> named_struct("
    f"'hi', (h.hi * {FNV_LOW} + shiftleft((h.lo ^ b) & 16777215L, 8) + shiftright((h.lo ^ b) * {FNV_LOW}, 32)) & {MASK32}L, 'lo', ((h.lo ^ b) * {FNV_LOW}) & {MASK32}L))"
)
_CLASS = "CASE " + " ".join(f"WHEN type_byte IN ({', '.join(map(str, m))}) THEN '{n}'" for n, m in VALUE_CLASSES.items()) + f" WHEN type_byte IN ({', '.join(map(str, VALUE_TYPES))}) THEN 'other' END"
_BULK = "concat('$', octet_length(x), '\\r\\n', x, '\\r\\n')"
#: Name, parameters, type, body. Later ones use earlier ones.
FUNCTIONS = (
    ("hash_tag", "key STRING", "STRING", "CASE WHEN instr(key, '{') > 0 AND instr(substring(key, instr(key, '{') + 1), '}') > 0 "
     "THEN substring(key, instr(key, '{') + 1, instr(substring(key, instr(key, '{') + 1), '}') - 1) ELSE key END"),
    ("crc16", "data STRING", "INT", _CRC),
    ("key_slot", "key STRING", "INT", f"crc16(hash_tag(key)) % {SLOTS}"),
    ("fnv1a_halves", "data STRING", "STRUCT<hi: BIGINT, lo: BIGINT>", _FNV),
    ("fnv1a", "data STRING", "DECIMAL(20, 0)", "cast(cast(fnv1a_halves(data).hi AS DECIMAL(20, 0)) * 4294967296BD + fnv1a_halves(data).lo AS DECIMAL(20, 0))"),
    ("worker_index", "data STRING, n INT", "BIGINT", "if(n = 0, 0L, ((fnv1a_halves(data).hi % n) * (4294967296L % n) + fnv1a_halves(data).lo % n) % n)"),
    ("resp_encode", "args ARRAY<STRING>", "STRING", f"concat('*', size(args), '\\r\\n', array_join(transform(args, x -> {_BULK}), ''))"),
    ("rdb_value_class", "type_byte INT", "STRING", _CLASS),
    ("has_prefix", "key STRING, prefixes ARRAY<STRING>", "BOOLEAN", "exists(prefixes, p -> startswith(key, p))"),
    ("in_ranges", "n INT, ranges ARRAY<STRUCT<s: INT, e: INT>>", "BOOLEAN", "exists(ranges, r -> n BETWEEN r.s AND r.e)"),
)


def register(spark: SparkSession) -> None:
    """Make the functions known to this session."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

"""Snapshot replay and log application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions.constants import METRICS, MODULE_TYPES
from kvloom.functions.hashing import crc64
from kvloom.functions.snapshot_types import string_code, ttl_ms
from kvloom.operators.prefix_sum import scan

DUMP_VERSION = 9


def dump_body(type_byte: Column, raw: Column, version: int = DUMP_VERSION) -> Column:
    """type ‖ raw ‖ version, little-endian; null if there is nothing to dump."""
    body = F.concat(F.unhex(F.lpad(F.hex(type_byte.cast("long")), 2, "0")), raw.cast("binary"), F.lit(version.to_bytes(2, "little")))
    return F.when(F.octet_length(raw) > 0, body)


def dump_payload(type_byte: Column, raw: Column, version: int = DUMP_VERSION) -> Column:
    """DUMP payload: body and CRC-64 of the body."""
    body = dump_body(type_byte, raw, version)
    return F.concat(body, crc64(body))


def dump_length(raw: Column) -> Column:
    return F.when(F.octet_length(raw) > 0, (F.octet_length(raw) + 11).cast("long"))


def replayable(rows: DataFrame) -> DataFrame:
    """Rows that are replayed: no modules, no rows without a raw value."""
    return rows.filter(~F.col("rdb_type").isin(*MODULE_TYPES) & F.col("raw_value").isNotNull() & (F.octet_length("raw_value") > 0))


def restore_commands(rows: DataFrame, now: Column) -> DataFrame:
    """(pos, db, args): RESTORE key ttl payload REPLACE for each replayable row (pos, db, key, raw_value, expire, rdb_type)."""
    payload = dump_payload(F.col("rdb_type"), F.col("raw_value"))
    b = lambda x: x.cast("binary")
    args = F.array(b(F.lit("RESTORE")), b(F.col("key")), b(ttl_ms(F.col("expire"), now).cast("string")), payload, b(F.lit("REPLACE")))
    return replayable(rows).select("pos", "db", args.alias("args"))


def select_switches(rows: DataFrame, by: str | None = None) -> DataFrame:
    """(pos, db): places before which a SELECT is sent; replay begins at database 0.

    Rows look back inside blocks of pos; the first of a block takes the last
    database of the block before, so that no window holds a whole snapshot.
    """
    keys = [by] if by else []
    d = scan(rows.select(*keys, "pos", "db"), keys, "pos", {"__was": ("last", F.col("db"))}, exclusive=True)
    return d.filter(F.coalesce("__was", F.lit(0)) != F.col("db")).select(*keys, "pos", "db")


def string_raw(value: Column) -> Column:
    return string_code(value)


def apply_log(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """(db, key, value, source): the keyspace after the log.

    snapshot (db, key, value); log (seq, db, key, cmd, value) of SET and DEL. The
    last write of a key wins. One aggregation with map-side combining, no sort:
    a key with a third of all writes is reduced before the shuffle.
    """
    s = snapshot.select("db", "key", "value", F.lit(-1).cast("long").alias("seq"), F.lit("SET").alias("cmd"), F.lit("snapshot").alias("source"))
    g = log.filter(F.col("cmd").isin("SET", "HSET", "DEL") & F.col("key").isNotNull())
    g = g.select("db", "key", "value", F.col("seq").cast("long").alias("seq"), "cmd", F.lit("log").alias("source"))
    last = s.unionByName(g).groupBy("db", "key").agg(F.max(F.struct("seq", "cmd", "value", "source")).alias("w"))
    return last.filter(F.col("w.cmd") != "DEL").select("db", "key", "w.value", "w.source")


def metrics(commands: DataFrame, dropped: Column, failed: Column, now_ms: int, progress: float) -> DataFrame:
    """One row with the five metrics over commands (ts); dropped and failed are conditions."""
    return commands.agg(
        ((F.lit(now_ms) - F.max(F.unix_millis("ts"))) / 1000.0).alias(METRICS[0]), F.lit(float(progress)).alias(METRICS[1]),
        F.count_if(~dropped).alias(METRICS[2]), F.count_if(dropped).alias(METRICS[3]), F.count_if(failed).alias(METRICS[4]),
    )


def prometheus_text(m: DataFrame) -> DataFrame:
    """(name, line): the metrics row as exposition lines, gauges first; plain decimals, six places at most."""
    kinds = dict(m.dtypes)

    def shown(n: str) -> Column:
        if kinds[n] != "double":
            return F.col(n).cast("string")
        return F.rtrim(F.rtrim(F.format_string("%.6f", F.col(n)), F.lit("0")), F.lit("."))

    pairs = [F.struct(F.lit(n).alias("name"), F.concat(F.lit(n + " "), shown(n)).alias("line")) for n in METRICS]
    return m.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", "p.line")

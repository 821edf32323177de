"""Replication relations derived from the driver's tables, as DataFrames and as DuckDB SQL.

commands: the command log; txn_commands: the log with transaction marks;
keyspace: a snapshot; segments: a catalogue over the log; ranges: slot ranges.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions.wire import wire_length
from kvloom.operators.prefix_sum import running_total

SEGMENT_BYTES = 20_000
#: The clock of expiry computations.
NOW = "1998-01-01 00:00:00"
#: The clock of the metrics.
NOW_MS = 1_800_000_000_000


def text(c: Column) -> Column:
    return c.cast("string")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def commands(self) -> DataFrame:
        c = F.col
        kind = F.pmod(c("event_id"), F.lit(5))
        user = text(c("user_id"))
        prefix = (
            F.when(kind == 0, "user:").when(kind == 1, "order:").when(kind == 2, "temp:").when(kind == 3, "cache:")
            .otherwise(F.concat(F.lit("{user:"), user, F.lit("}:")))
        )
        cmd = (
            F.when(c("event_type") == "click", "SET").when(c("event_type") == "view", "GET").when(c("event_type") == "purchase", "HSET")
            .when(c("event_type") == "signup", "DEL").otherwise("CONFIG")
        )
        d = self.table("events").select(
            c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"), F.concat(F.lit("run_"), text(c("user_id") % 3)).alias("run_id"),
            (c("event_id") % 4).cast("int").alias("db"), cmd.alias("cmd"), F.concat(prefix, user).alias("k"), c("props").alias("val"),
        )
        key = F.when(c("cmd") != "CONFIG", c("k"))
        args = (
            F.when(c("cmd") == "SET", F.array("cmd", "k", "val")).when(c("cmd") == "HSET", F.array(c("cmd"), c("k"), F.lit("f"), c("val")))
            .when(c("cmd").isin("GET", "DEL"), F.array("cmd", "k")).otherwise(F.array(c("cmd"), F.lit("GET"), F.lit("timeout")))
        )
        return d.withColumn("key", key).withColumn("args", args).drop("k")

    @cached_property
    def offsets(self) -> DataFrame:
        """commands with wire_len, start_offset and end_offset in their run."""
        d = self.commands.withColumn("wire_len", wire_length(F.col("args")))
        d = running_total(d, "run_id", "seq", "wire_len", "end_offset")
        return d.withColumn("start_offset", F.col("end_offset") - F.col("wire_len"))

    @cached_property
    def txn_commands(self) -> DataFrame:
        m = F.col("seq") % 7
        cmd = F.when(m == 0, "MULTI").when(m == 3, "EXEC").when((m == 5) & (F.col("seq") % 3 == 0), "DISCARD").otherwise(F.col("cmd"))
        return self.commands.withColumn("cmd", cmd)

    @cached_property
    def keyspace(self) -> DataFrame:
        never = F.lit(None).cast("timestamp")

        def rows(name: str, prefix: str, pk: str, kind: int, db: Column, expire: Column, value: str) -> DataFrame:
            return self.table(name).select(
                F.concat(F.lit(prefix), text(F.col(pk))).alias("key"), F.lit(kind).alias("rdb_type"), (db % 4).cast("int").alias("db"),
                expire.alias("expire"), text(F.col(value)).alias("value"),
            )

        c = F.col
        return (
            rows("customer", "customer:", "c_custkey", 0, c("c_nationkey"), never, "c_name")
            .union(rows("orders", "order:", "o_orderkey", 4, c("o_custkey"), c("o_orderdate").cast("timestamp"), "o_orderstatus"))
            .union(rows("part", "part:", "p_partkey", 5, c("p_size"), never, "p_name"))
            .union(rows("supplier", "supplier:", "s_suppkey", 2, c("s_nationkey"), never, "s_name"))
            .union(rows("nation", "nation:", "n_nationkey", 1, c("n_regionkey"), never, "n_name"))
        )

    @cached_property
    def segments(self) -> DataFrame:
        """A log segment for each SEGMENT_BYTES of a run, and a snapshot over every third."""
        b = self.offsets.groupBy("run_id", F.floor(F.col("start_offset") / SEGMENT_BYTES).alias("b")).agg(
            F.min("start_offset").alias("offset"), F.sum("wire_len").cast("long").alias("size"), F.min("ts").alias("created_at")
        )
        log = b.select("run_id", F.lit("aof").alias("kind"), "offset", "size", "created_at")
        snap = b.filter(F.col("b") % 3 == 0).select("run_id", F.lit("rdb").alias("kind"), "offset", F.floor(F.col("size") / 2).alias("size"), "created_at")
        return log.union(snap)

    @cached_property
    def probes(self) -> DataFrame:
        """Offsets that are looked up: the start of every command, and 30,000 bytes after each, which lies past the end for the last ones."""
        return self.offsets.select("run_id", F.explode(F.array(F.col("start_offset"), F.col("start_offset") + 30_000)).alias("o")).distinct()

    @cached_property
    def ranges(self) -> DataFrame:
        s = (F.col("n_nationkey") * 37) % 500
        return self.table("nation").select(s.alias("s"), (s + (F.col("n_nationkey") % 4) * 9).alias("e"))

    @cached_property
    def saves(self) -> DataFrame:
        """Checkpoint saves: of every command."""
        return self.offsets.select(
            F.col("run_id").alias("replid"), "seq", F.col("end_offset").alias("offset"), F.unix_seconds("ts").alias("mtime")
        )


_ARGS_LEN = """CASE cmd
    WHEN 'SET' THEN 3 + 1 + (strlen(cmd) + len(strlen(cmd)::VARCHAR) + 5) + (strlen(k) + len(strlen(k)::VARCHAR) + 5) + (strlen(val) + len(strlen(val)::VARCHAR) + 5)
    WHEN 'HSET' THEN 3 + 1 + (strlen(cmd) + len(strlen(cmd)::VARCHAR) + 5) + (strlen(k) + len(strlen(k)::VARCHAR) + 5) + 7 + (strlen(val) + len(strlen(val)::VARCHAR) + 5)
    WHEN 'CONFIG' THEN 3 + 1 + (6 + 1 + 5) + (3 + 1 + 5) + (7 + 1 + 5)
    ELSE 3 + 1 + (strlen(cmd) + len(strlen(cmd)::VARCHAR) + 5) + (strlen(k) + len(strlen(k)::VARCHAR) + 5) END"""

VIEW_SQL = {
    "commands": f"""
  SELECT seq, ts, run_id, db, cmd, CASE WHEN cmd <> 'CONFIG' THEN k END AS key, val,
    CASE WHEN cmd = 'SET' THEN [cmd, k, val] WHEN cmd = 'HSET' THEN [cmd, k, 'f', val]
         WHEN cmd IN ('GET', 'DEL') THEN [cmd, k] ELSE [cmd, 'GET', 'timeout'] END AS args,
    ({_ARGS_LEN})::BIGINT AS wire_len
  FROM (SELECT event_id AS seq, ts, 'run_' || (user_id % 3)::VARCHAR AS run_id, (event_id % 4)::INTEGER AS db, props AS val,
    CASE event_type WHEN 'click' THEN 'SET' WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'HSET' WHEN 'signup' THEN 'DEL' ELSE 'CONFIG' END AS cmd,
    CASE event_id % 5 WHEN 0 THEN 'user:' WHEN 1 THEN 'order:' WHEN 2 THEN 'temp:' WHEN 3 THEN 'cache:'
         ELSE '{{user:' || user_id::VARCHAR || '}}:' END || user_id::VARCHAR AS k
    FROM events)""",
    "offsets": """
  SELECT *, end_offset - wire_len AS start_offset FROM (
    SELECT *, (sum(wire_len) OVER (PARTITION BY run_id ORDER BY seq))::BIGINT AS end_offset FROM commands)""",
    "txn_commands": """
  SELECT seq, run_id, CASE WHEN seq % 7 = 0 THEN 'MULTI' WHEN seq % 7 = 3 THEN 'EXEC'
    WHEN seq % 7 = 5 AND seq % 3 = 0 THEN 'DISCARD' ELSE cmd END AS cmd FROM commands""",
    "keyspace": """
  SELECT 'customer:' || c_custkey::VARCHAR AS key, 0 AS rdb_type, (c_nationkey % 4)::INTEGER AS db, NULL::TIMESTAMP AS expire, c_name::VARCHAR AS value FROM customer
  UNION ALL SELECT 'order:' || o_orderkey::VARCHAR, 4, (o_custkey % 4)::INTEGER, o_orderdate::TIMESTAMP, o_orderstatus::VARCHAR FROM orders
  UNION ALL SELECT 'part:' || p_partkey::VARCHAR, 5, (p_size % 4)::INTEGER, NULL, p_name::VARCHAR FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey::VARCHAR, 2, (s_nationkey % 4)::INTEGER, NULL, s_name::VARCHAR FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey::VARCHAR, 1, (n_regionkey % 4)::INTEGER, NULL, n_name::VARCHAR FROM nation""",
    "buckets": f"""
  SELECT run_id, start_offset // {SEGMENT_BYTES} AS b, min(start_offset)::BIGINT AS "offset", sum(wire_len)::BIGINT AS size, min(ts) AS created_at
  FROM offsets GROUP BY run_id, b""",
    "segments": """
  SELECT run_id, 'aof' AS kind, "offset", size, created_at FROM buckets
  UNION ALL SELECT run_id, 'rdb', "offset", size // 2, created_at FROM buckets WHERE b % 3 = 0""",
    "probes": """
  SELECT run_id, start_offset AS o FROM offsets UNION SELECT run_id, start_offset + 30000 FROM offsets""",
    "ranges": """
  SELECT (n_nationkey * 37) % 500 AS s, (n_nationkey * 37) % 500 + (n_nationkey % 4) * 9 AS e FROM nation""",
    "saves": """
  SELECT run_id AS replid, seq, end_offset AS "offset", (epoch_us(ts) // 1000000)::BIGINT AS mtime FROM offsets""",
}
_NEEDS = {
    "offsets": ["commands"], "txn_commands": ["commands"], "buckets": ["offsets"], "segments": ["buckets"], "probes": ["offsets"], "saves": ["offsets"],
}


def with_views(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause that defines the views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([f"{n} AS ({VIEW_SQL[n]})" for n in order] + ([more] if more else [])) + "\n"

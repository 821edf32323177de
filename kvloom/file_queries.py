"""Registered queries through real files and encoded bytes: snapshots, logs, decoding, log application; and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.functions import elements as X
from kvloom.functions import snapshot_types as T
from kvloom.functions import wire as W
from kvloom.functions.constants import ACK_MS
from kvloom.operators import apply as Y
from kvloom.operators import replay as P
from kvloom.operators import segments as S
from kvloom.operators import rules as U
from kvloom.operators.prefix_sum import numbered
from kvloom.plans.views import NOW_MS, Views, with_views
from kvloom.queries import ENCODED, query
from kvloom.sources import rdb, resp
from kvloom.sources import segments as G
from kvloom.sources.shared import shared_folder

c, lit = F.col, F.lit
LOG_BYTES = 20_000


def _spark_writes(df: DataFrame) -> list:
    """Run what df writes; it has a row for each file."""
    return df.collect()


# Snapshot files --------------------------------------------------------

# Raw values: strings plain, as an 8-, 16- or 32-bit integer, or compressed; lists, sets, hashes, sorted sets of one element.
CODE_HEX = "CASE WHEN octet_length(encode(value)) < 64 THEN printf('%02X', octet_length(encode(value))) ELSE printf('%04X', octet_length(encode(value)) + 16384) END"
STRING_HEX = f"{CODE_HEX} || hex(encode(value))"
SNAPSHOT_ROWS = f"""o AS (SELECT *, row_number() OVER (ORDER BY key) AS p FROM keyspace),
f AS (SELECT 'run_' || (p % 3)::VARCHAR AS run_id, row_number() OVER (PARTITION BY p % 3 ORDER BY p) - 1 AS pos, * EXCLUDE (value),
  CASE WHEN rdb_type <> 0 THEN value WHEN p % 6 = 1 THEN (p % 100)::VARCHAR WHEN p % 6 = 2 THEN (-(p % 20000) - 300)::VARCHAR WHEN p % 6 = 3 THEN (p + 70000)::VARCHAR ELSE value END AS value,
  value AS text FROM o),
entries AS (SELECT run_id, pos, db, key, rdb_type, CASE WHEN rdb_type = 0 THEN value END AS value,
  CASE rdb_type WHEN 1 THEN '01' || {STRING_HEX} WHEN 2 THEN '01' || {STRING_HEX} WHEN 4 THEN '010166' || {STRING_HEX} WHEN 5 THEN '01' || {STRING_HEX} || '000000000000F03F'
    ELSE CASE p % 6 WHEN 1 THEN 'C0' || printf('%02X', p % 100)
      WHEN 2 THEN 'C1' || printf('%02X%02X', (65536 - p % 20000 - 300) % 256, (65536 - p % 20000 - 300) // 256)
      WHEN 3 THEN 'C2' || printf('%02X%02X%02X%02X', (p + 70000) % 256, (p + 70000) // 256 % 256, (p + 70000) // 65536 % 256, (p + 70000) // 16777216)
      WHEN 4 THEN 'C3' || printf('%02X%02X%02X', strlen(text) + 1, strlen(text), strlen(text) - 1) || hex(encode(text))
      ELSE {STRING_HEX} END END AS raw,
  CASE WHEN expire IS NOT NULL THEN CASE WHEN p % 2 = 0 THEN epoch_ms(expire) + 7 ELSE epoch_ms(expire) // 1000 * 1000 END END AS expire_ms FROM f)"""


def _entries(v: Views) -> DataFrame:
    """(run_id, pos, db, key, rdb_type, raw_value, expire_ms, lead) of three snapshot files; each ends with a module and a stream of every version."""
    p, text = c("p"), c("value")
    little = lambda x, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(n)])
    b = lambda x: F.unhex(lit(x))
    plain = T.string_code(text)
    # Compressed: one run of literal bytes.
    literal = F.concat(b("C3"), little(F.octet_length(text) + 1, 1), little(F.octet_length(text), 1), little(F.octet_length(text) - 1, 1), text.cast("binary"))
    number = p.cast("long")
    string = (
        F.when(p % 6 == 1, F.concat(b("C0"), little(number % 100, 1))).when(p % 6 == 2, F.concat(b("C1"), little(-(number % 20000) - 300, 2)))
        .when(p % 6 == 3, F.concat(b("C2"), little(number + 70000, 4))).when(p % 6 == 4, literal).otherwise(plain)
    )
    kind = c("rdb_type")
    raw = (
        F.when(kind.isin(1, 2), F.concat(b("01"), plain)).when(kind == 4, F.concat(b("010166"), plain))
        .when(kind == 5, F.concat(b("01"), plain, b("000000000000F03F"))).otherwise(string)
    )
    ms = F.unix_millis("expire")
    # Expiry in milliseconds, or in seconds as an opcode; idle time, frequency, table sizes and module data before some entries.
    seconds = F.when(c("expire").isNotNull() & (p % 2 == 1), F.concat(b("FD"), little(F.floor(ms / 1000), 4))).otherwise(b(""))
    lead = F.concat(seconds, F.when(p % 5 == 0, b("F807F903")).when(p % 11 == 0, b("FB0A02")).when(p % 13 == 0, b("F701020500")).otherwise(b("")))
    d = numbered(v.keyspace, "key", "p").withColumn("run_id", F.concat(lit("run_"), (p % 3).cast("string")))
    rows = d.select(
        "run_id", F.floor(p / 3).alias("place"), "db", "key", kind, raw.alias("raw_value"),
        F.when(c("expire").isNotNull() & (p % 2 == 0), ms + 7).alias("expire_ms"), lead.alias("lead"),
    )
    # A module with a number and a string; streams: empty, and with one block of entries and a group with a pending entry and a consumer.
    block, waits, id24 = "01" + "10" + "00" * 16 + "0164", "01" + "AA" * 16, "01" + "AA" * 24 + "01"
    older = block + "00" * 2 + "01" + "0167" + "00" * 2 + id24 + "01" + "0163" + "CC" * 8 + waits
    newer = block + "00" * 7 + "01" + "0167" + "00" * 3 + id24 + "01" + "0163" + "CC" * 16 + waits
    special = [(22, "01" + "0205" + "050178" + "00"), (15, "00" * 4), (15, older), (19, newer), (21, newer)]
    last = v.spark.createDataFrame([(f"run_{r}", 1 << 40, 3, f"special:{i}", t, bytearray.fromhex(x)) for r in range(3) for i, (t, x) in enumerate(special)],
                                   "run_id string, place long, db int, key string, rdb_type int, raw_value binary")
    rows = rows.unionByName(last.withColumns({"expire_ms": lit(None).cast("long"), "lead": lit(None).cast("binary")}))
    return rows.withColumn("pos", F.struct("place", "key"))


def _snapshot_store(v: Views, aux: dict | None = None) -> str:
    base = shared_folder(v.spark, "snapshots")
    _spark_writes(G.write_snapshots(_entries(v), base, offset=100, aux=aux or {"redis-ver": "7.2.0", "ctime": "1"}))
    return base


# The three runs of SNAPSHOT_ROWS one after the other in one file.
SPLIT_SQL = with_views("keyspace", more=SNAPSHOT_ROWS + """, n AS (SELECT run_id, count(*) AS n FROM entries GROUP BY run_id),
u AS (SELECT run_id, pos, db, key, rdb_type, value, raw, expire_ms FROM entries
  UNION ALL SELECT run_id, n + i - 1, 3, 'special:' || i::VARCHAR, [15, 15, 19, 21][i], NULL, NULL, NULL FROM n, (SELECT unnest([1, 2, 3, 4]) AS i))""") + "SELECT row_number() OVER (ORDER BY run_id, pos) - 1 AS pos, db, key, rdb_type, value, raw, expire_ms FROM u"


@query(with_views("keyspace", more=SNAPSHOT_ROWS + """, n AS (SELECT run_id, count(*) AS n FROM entries GROUP BY run_id)""") + """SELECT run_id, pos, db, key, rdb_type, value, raw, expire_ms FROM entries
  UNION ALL SELECT run_id, n + i - 1, 3, 'special:' || i::VARCHAR, [15, 15, 19, 21][i], NULL, NULL, NULL FROM n, (SELECT unnest([1, 2, 3, 4]) AS i)""")
def rdb_scan(v):
    """Three snapshot files of all value types, written and read back."""
    d = rdb.read_snapshots(v.spark, _snapshot_store(v), check_crc=True)
    return d.select("run_id", "pos", "db", c("key").cast("string").alias("key"), "rdb_type", c("value").cast("string").alias("value"), F.hex("raw_value").alias("raw"), F.unix_millis("expire").alias("expire_ms"))


@query(SPLIT_SQL)
def rdb_split_scan(v):
    """One snapshot file, cut by an index of boundaries about every 4 KiB, its parts read by several tasks."""
    d = _entries(v).withColumns({"pos": F.struct("run_id", "pos"), "run_id": lit("run_0")})
    base = shared_folder(v.spark, "one-snapshot")
    _spark_writes(G.write_snapshots(d, base, offset=100))
    d = rdb.read_snapshots(v.spark, base, split=4096)
    return d.select("pos", "db", c("key").cast("string").alias("key"), "rdb_type", c("value").cast("string").alias("value"), F.hex("raw_value").alias("raw"), F.unix_millis("expire").alias("expire_ms"))


@query(with_views("keyspace") + """SELECT 'run_' || i AS run_id, unnest(['redis-ver', 'keys', 'first-key', 'repl-id']) AS key, unnest(['7.2.0', n::VARCHAR, k, 'run_' || i]) AS value
  FROM (SELECT count(*) AS n, min(key) AS k FROM keyspace), (SELECT unnest([0, 1, 2]) AS i)""")
def rdb_aux(v):
    """AUX pairs of snapshot files, which tell of the keyspace that was saved."""
    n, first = v.keyspace.agg(F.count("*"), F.min("key")).first()
    d = rdb.read_aux(v.spark, _snapshot_store(v, {"redis-ver": "7.2.0", "keys": str(n), "first-key": first}))
    return d.select("run_id", c("key").cast("string").alias("key"), c("value").cast("string").alias("value"))


@query(with_views("keyspace", more=SNAPSHOT_ROWS) + "SELECT rdb_type, count(*) AS n, sum(strlen(raw) // 2 + 11)::BIGINT AS payload_bytes FROM entries GROUP BY rdb_type")
def rdb_replay_sizes(v):
    """DUMP payloads of what a snapshot file holds; streams and modules have none."""
    d = P.replayable(rdb.read_snapshots(v.spark, _snapshot_store(v)))
    return d.groupBy(c("rdb_type")).agg(F.count("*").alias("n"), F.sum(P.dump_length(c("raw_value"))).alias("payload_bytes"))


# Log files -------------------------------------------------------------

SEGMENT_ROWS = f"""e AS (SELECT run_id, seq, start_offset, end_offset, args, {ENCODED} AS raw FROM offsets),
i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM e),
w AS (SELECT run_id, i, seq, start_offset, end_offset, raw, 0::BIGINT AS seg FROM i WHERE i = 1
  UNION ALL
  SELECT i.run_id, i.i, i.seq, i.start_offset, i.end_offset, i.raw, CASE WHEN w.end_offset - w.seg >= {LOG_BYTES} THEN w.end_offset ELSE w.seg END FROM w JOIN i ON i.run_id = w.run_id AND i.i = w.i + 1)"""


def _log_store(v: Views) -> str:
    base = shared_folder(v.spark, "logs")
    _spark_writes(G.write_logs(v.commands.select("run_id", "seq", W.encode_command(c("args")).alias("raw")), base, LOG_BYTES))
    return base


@query(with_views("offsets", more=SEGMENT_ROWS, recursive=True) + "SELECT run_id, 'aof' AS kind, seg AS \"offset\", sum(strlen(raw))::BIGINT AS size FROM w GROUP BY run_id, seg")
def log_segments(v):
    """Rotated log files, listed."""
    return S.read_catalogue(v.spark, _log_store(v)).select("run_id", "kind", "offset", "size")


@query(with_views("offsets") + "SELECT run_id, start_offset, end_offset, cmd AS name, array_to_string(args[2:], '|') AS args FROM offsets")
def log_scan(v):
    """Commands decoded from rotated log files, with their offsets."""
    d = resp.read_logs(v.spark, _log_store(v))
    return d.select("run_id", "start_offset", "end_offset", "name", F.array_join(F.transform("args", lambda a: a.cast("string")), "|").alias("args"))


# Every third value holds what looks like the begin of a command.
LOOKALIKE = """x AS (SELECT seq, run_id, cmd, list_concat(args, CASE WHEN seq % 3 = 0 THEN ['a' || chr(13) || chr(10) || '*3' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'SET' || chr(13) || chr(10) || '$9' || chr(13) || chr(10)] ELSE [] END) AS args FROM commands),
y AS (SELECT seq, cmd, args, (strlen(len(args)::VARCHAR) + 3 + list_sum(list_transform(args, lambda a: strlen(strlen(a)::VARCHAR) + 5 + strlen(a))))::BIGINT AS n FROM x)"""


@query(with_views("commands", more=LOOKALIKE) + "SELECT (sum(n) OVER (ORDER BY seq) - n)::BIGINT AS start_offset, (sum(n) OVER (ORDER BY seq))::BIGINT AS end_offset, cmd AS name, array_to_string(args[2:], '|') AS args FROM y")
def log_split_scan(v):
    """One log with values that hold command headers, cut every 4 KiB, its splits decoded by several tasks."""
    more = F.when(c("seq") % 3 == 0, F.array(lit("a\r\n*3\r\n$3\r\nSET\r\n$9\r\n"))).otherwise(F.array().cast("array<string>"))
    base = shared_folder(v.spark, "one-log")
    _spark_writes(G.write_logs(v.commands.select(lit("run_0").alias("run_id"), "seq", W.encode_command(F.concat("args", more)).alias("raw")), base))
    d = resp.read_logs(v.spark, base, split=4096)
    return d.select("start_offset", "end_offset", "name", F.array_join(F.transform("args", lambda a: a.cast("string")), "|").alias("args"))


@query(with_views("offsets", more=SEGMENT_ROWS + """, t AS (SELECT run_id, seg, string_agg(raw, '' ORDER BY seq) AS data FROM w GROUP BY run_id, seg)""", recursive=True)
       + "SELECT w.run_id, start_offset + 3 AS o, hex(encode(substr(data, start_offset + 3 - w.seg + 1, 70))) AS content FROM w JOIN t ON w.run_id = t.run_id AND w.seg = t.seg")
def segment_reads(v):
    """70 bytes from the fourth byte of every command on, as far as its log file goes."""
    wanted = v.offsets.select("run_id", (c("start_offset") + 3).alias("o"), lit(70).cast("long").alias("size"))
    return G.read_ranges(v.spark, _log_store(v), wanted).select("run_id", "o", F.hex("content").alias("content"))


RECEIVED = """b AS (SELECT 'run_' || c_nationkey AS run_id, c_nationkey::BIGINT * 1000 AS base, string_agg(c_name, '' ORDER BY c_custkey) AS data FROM customer GROUP BY c_nationkey),
w AS (SELECT run_id, base, data, base + c_custkey * 37 % (strlen(data) + 40) - 20 AS o FROM customer JOIN b ON run_id = 'run_' || c_nationkey)"""


@query(f"WITH {RECEIVED} SELECT DISTINCT run_id, o, substr(data, (o - base + 1)::BIGINT, 25) AS content FROM w WHERE o >= base AND o < base + strlen(data)")
def snapshot_reads(v):
    """25 bytes, or what is left, from places inside and outside of snapshot files that hold bytes as they were received."""
    per = v.table("customer").groupBy(c("c_nationkey").alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "").alias("data"))
    blobs = per.select(F.concat(lit("run_"), c("n").cast("string")).alias("run_id"), (c("n").cast("long") * 1000).alias("offset"), "data", "n")
    base = shared_folder(v.spark, "received")
    _spark_writes(G.write_received(blobs, base))
    place = c("offset") + c("c_custkey") * 37 % (F.octet_length("data") + 40) - 20
    wanted = v.table("customer").join(blobs, c("c_nationkey") == c("n")).select("run_id", place.alias("o"), lit(25).cast("long").alias("size")).distinct()
    return G.read_snapshot_ranges(v.spark, base, wanted).select("run_id", "o", c("content").cast("string").alias("content"))


# Decoding --------------------------------------------------------------

# A value of each kind, malformed ones, a cut one and one over the cap of 120 bytes.
ENCODINGS = """CASE seq % 11 WHEN 0 THEN '+OK' WHEN 1 THEN '-ERR ' || cmd WHEN 2 THEN ':' || (seq - 500)::VARCHAR WHEN 3 THEN '$' || strlen(cmd) || chr(13) || chr(10) || cmd WHEN 4 THEN '$-1'
  WHEN 5 THEN '*2' || chr(13) || chr(10) || '$' || strlen(cmd) || chr(13) || chr(10) || cmd || chr(13) || chr(10) || ':' || seq WHEN 6 THEN '*-1' WHEN 7 THEN '?' || cmd WHEN 8 THEN ':x' || seq WHEN 9 THEN '$-5'
  ELSE CASE WHEN seq % 2 = 0 THEN '$500' || chr(13) || chr(10) || cmd ELSE '+' || repeat('x', 130) END END || chr(13) || chr(10)"""
DECODED = """CASE seq % 11 WHEN 0 THEN ['simple', '+OK', ''] WHEN 1 THEN ['error', '-ERR ' || cmd, ''] WHEN 2 THEN ['integer', ':' || (seq - 500)::VARCHAR, ''] WHEN 3 THEN ['bulk', '$' || strlen(cmd) || ' (' || cmd || ')', '']
  WHEN 4 THEN ['null', '$-1 (Null)', ''] WHEN 5 THEN ['array', '*2 [$' || strlen(cmd) || ' (' || cmd || '), :' || seq || ']', ''] WHEN 6 THEN ['null', '$-1 (Null)', '']
  WHEN 7 THEN [NULL, NULL, 'InvalidType'] WHEN 8 THEN [NULL, NULL, 'InvalidInteger'] WHEN 9 THEN [NULL, NULL, 'InvalidLength']
  ELSE CASE WHEN seq % 2 = 0 THEN [NULL, NULL, ''] ELSE [NULL, NULL, 'BufferOverflow'] END END"""


@query(with_views("commands", more=f"x AS (SELECT seq, {ENCODINGS} AS raw, {DECODED} AS d FROM commands)")
       + "SELECT seq, d[1] AS tag, d[2] AS text, CASE WHEN d[1] IS NULL THEN 0 ELSE strlen(raw) END AS used, nullif(d[3], '') AS error FROM x")
def resp_decode(v):
    m, cmd, seq = c("seq") % 11, c("cmd"), c("seq").cast("string")
    text = lambda *x: F.concat(*[lit(y) if isinstance(y, str) else y for y in x])
    bulk = text("$", F.octet_length(cmd).cast("string"), "\r\n", cmd)
    raw = (
        F.when(m == 0, "+OK").when(m == 1, text("-ERR ", cmd)).when(m == 2, text(":", (c("seq") - 500).cast("string"))).when(m == 3, bulk).when(m == 4, "$-1")
        .when(m == 5, text("*2\r\n", bulk, "\r\n:", seq)).when(m == 6, "*-1").when(m == 7, text("?", cmd)).when(m == 8, text(":x", seq)).when(m == 9, "$-5")
        .when(c("seq") % 2 == 0, text("$500\r\n", cmd)).otherwise("+" + "x" * 130)
    )
    d = v.commands.select("seq", F.concat(raw, lit("\r\n")).cast("binary").alias("raw"))
    return resp.decode_values(d, "raw", limit=120).withColumnRenamed("_error", "error")


# Log application -------------------------------------------------------

# A log over three databases with options, several keys, flushes, an unknown command and a malformed end.
SYNC_ARGS = """CASE event_id % 13 WHEN 0 THEN ['SELECT', (event_id // 13 % 3)::VARCHAR] WHEN 3 THEN ['set', k0, v, 'PX', '60000'] WHEN 4 THEN ['DEL', k0, k5] WHEN 5 THEN ['HSET', h, 'f1', 'a' || v, 'f2', 'b' || v]
  WHEN 6 THEN ['HDEL', h, 'f1'] WHEN 7 THEN ['EXPIRE', k0, '100'] WHEN 8 THEN ['PERSIST', k1] WHEN 9 THEN ['MSET', k0, 'm' || v, k3, 'm' || v]
  WHEN 10 THEN CASE WHEN event_id % 403 = 10 THEN ['FLUSHDB'] ELSE ['GET', k0] END WHEN 11 THEN ['LPUSH', k0, k1] ELSE ['SET', k0, v] END"""
SYNC_LOG = f"""s AS (SELECT event_id AS seq, 'run_' || (event_id % 2)::VARCHAR AS run_id, 'k' || (event_id % 97)::VARCHAR AS k0, 'k' || ((event_id + 1) % 97)::VARCHAR AS k1, 'k' || ((event_id + 3) % 97)::VARCHAR AS k3,
  'k' || ((event_id + 5) % 97)::VARCHAR AS k5, 'h' || (event_id % 31)::VARCHAR AS h, 'v' || event_id::VARCHAR AS v, event_id FROM events),
a AS (SELECT seq, run_id, {SYNC_ARGS} AS args FROM s),
g AS (SELECT *, args[1] AS cmd, coalesce(last_value(CASE WHEN args[1] = 'SELECT' THEN args[2]::INTEGER END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq), 0) AS db FROM a),
log AS (SELECT run_id || '/' || lpad(seq::VARCHAR, 12, '0') AS place, * FROM g)"""
SYNC_STATE = """flushed AS (SELECT db, max(place) AS place FROM log WHERE cmd = 'FLUSHDB' GROUP BY db),
snap AS (SELECT (n_nationkey % 4)::INTEGER AS db, 'k' || (n_nationkey * 4)::VARCHAR AS key, n_name AS value FROM nation),
hashes AS (SELECT (n_nationkey % 4)::INTEGER AS db, 'h' || n_nationkey::VARCHAR AS key, n_name, n_regionkey FROM nation),
whole AS (
  SELECT '' AS place, db, key, value, NULL::BIGINT AS expire_ms, 'snapshot' AS source FROM snap
  UNION ALL SELECT place, db, args[2], args[3], CASE WHEN len(args) = 5 THEN NOW + 60000 END, 'log' FROM log WHERE upper(cmd) = 'SET'
  UNION ALL SELECT place, db, args[2], args[3], NULL, 'log' FROM log WHERE cmd = 'MSET'
  UNION ALL SELECT place, db, args[4], args[5], NULL, 'log' FROM log WHERE cmd = 'MSET'
  UNION ALL SELECT place, db, unnest(args[2:]), NULL, NULL, NULL FROM log WHERE cmd = 'DEL'),
last AS (SELECT w.db, key, max_by(struct_pack(a := w.place, v := value, e := expire_ms, s := source), w.place) AS w FROM whole w LEFT JOIN flushed f ON w.db = f.db WHERE f.place IS NULL OR w.place > f.place GROUP BY w.db, key),
ttl AS (SELECT place, db, args[2] AS key, CASE WHEN cmd = 'EXPIRE' THEN NOW + 100000 END AS expire_ms FROM log WHERE cmd IN ('EXPIRE', 'PERSIST')),
strings AS (
  SELECT l.db, l.key, NULL AS field, l.w.v AS value, CASE WHEN max(t.place) IS NULL THEN l.w.e ELSE max_by(struct_pack(e := t.expire_ms), t.place).e END AS expire_ms, l.w.s AS source
  FROM last l LEFT JOIN ttl t ON t.db = l.db AND t.key = l.key AND t.place > l.w.a WHERE l.w.s IS NOT NULL GROUP BY l.db, l.key, l.w),
hash AS (
  SELECT '' AS place, db, key, unnest(['f1', 'f3']) AS field, unnest([n_name, n_regionkey::VARCHAR]) AS value FROM hashes
  UNION ALL SELECT place, db, args[2] AS key, args[3] AS field, args[4] AS value FROM log WHERE cmd = 'HSET' UNION ALL SELECT place, db, args[2], args[5], args[6] FROM log WHERE cmd = 'HSET'
  UNION ALL SELECT place, db, args[2], args[3], NULL FROM log WHERE cmd = 'HDEL'),
fields AS (SELECT h.db, key, field, max_by(struct_pack(v := value), h.place).v AS value, max(h.place) AS place FROM hash h LEFT JOIN flushed f ON h.db = f.db WHERE f.place IS NULL OR h.place > f.place GROUP BY h.db, key, field)""".replace("NOW", str(NOW_MS))


def _sync_log(v: Views) -> DataFrame:
    """(run_id, seq, name, args, _error) of the log, read from files; the end of each run is malformed."""
    n = c("event_id")
    named = lambda prefix, add, of: F.concat(lit(prefix), ((n + add) % of).cast("string"))
    k, val = (lambda add: named("k", add, 97)), F.concat(lit("v"), n.cast("string"))
    h, m = named("h", 0, 31), n % 13
    args = lambda *x: F.array(*[lit(y) if isinstance(y, str) else y for y in x])
    more = lambda p: F.concat(lit(p), val)
    cmd = (
        F.when(m == 0, args("SELECT", (F.floor(n / 13) % 3).cast("string"))).when(m == 3, args("set", k(0), val, "PX", "60000")).when(m == 4, args("DEL", k(0), k(5)))
        .when(m == 5, args("HSET", h, "f1", more("a"), "f2", more("b"))).when(m == 6, args("HDEL", h, "f1")).when(m == 7, args("EXPIRE", k(0), "100"))
        .when(m == 8, args("PERSIST", k(1))).when(m == 9, args("MSET", k(0), more("m"), k(3), more("m"))).when((m == 10) & (n % 403 == 10), args("FLUSHDB"))
        .when(m == 10, args("GET", k(0))).when(m == 11, args("LPUSH", k(0), k(1))).otherwise(args("SET", k(0), val))
    )
    rows = v.table("events").select(F.concat(lit("run_"), (n % 2).cast("string")).alias("run_id"), n.alias("seq"), W.encode_command(cmd).alias("raw"))
    bad = v.spark.createDataFrame([("run_0", 1 << 60, ":1x\r\n"), ("run_1", 1 << 60, "!\r\n")], "run_id string, seq long, raw string")
    base = shared_folder(v.spark, "sync")
    _spark_writes(G.write_logs(rows.union(bad), base))
    log = resp.read_logs(v.spark, base)
    return Y.in_database(log.withColumn("seq", c("start_offset")))


@query(with_views(more=SYNC_LOG + ", " + SYNC_STATE) + "SELECT * FROM strings UNION ALL SELECT db, key, field, value, NULL, CASE WHEN place = '' THEN 'snapshot' ELSE 'log' END FROM fields WHERE value IS NOT NULL")
def sync_apply(v):
    """A snapshot file of strings and hashes of every encoding, and a log of several databases, applied."""
    d = Y.apply(_sync_snapshot(v), _sync_log(v), NOW_MS)
    return d.select("db", *[c(x).cast("string").alias(x) for x in ("key", "field", "value")], "expire_ms", "source")


def _sync_snapshot(v: Views) -> DataFrame:
    """(db, key, field, value, expire_ms) of a snapshot file: a string for each nation, and a hash whose encoding follows its number."""
    n = c("n_nationkey")
    item = lambda field, value: F.struct(lit(None).cast("int").alias("place"), lit(field).cast("binary").alias("field"), value.cast("binary").alias("value"), lit(None).cast("double").alias("score"))
    rows = v.table("nation").select(n.alias("n"), (n % 4).cast("int").alias("db"), "n_name", F.array(item("f1", c("n_name")), item("f3", c("n_regionkey").cast("string"))).alias("items"))
    strings = rows.select("n", "db", F.concat(lit("k"), (c("n") * 4).cast("string")).alias("key"), lit(0).alias("rdb_type"), T.string_code(c("n_name")).alias("raw_value"))
    hashes = rows.select("n", "db", F.concat(lit("h"), c("n").cast("string")).alias("key"), F.get(F.array(*[lit(t) for t in (4, 9, 13, 16)]), c("n") % 4).alias("rdb_type"), "items")
    both = strings.unionByName(X.pack_values(hashes, "n", "db", "key"))
    both = both.select(lit("run_0").alias("run_id"), F.struct("n", "key").alias("pos"), "db", "key", "raw_value", lit(None).cast("long").alias("expire_ms"), "rdb_type", lit(None).cast("binary").alias("lead"))
    base = shared_folder(v.spark, "sync-snapshot")
    _spark_writes(G.write_snapshots(both, base))
    return X.entries(rdb.read_snapshots(v.spark, base))


@query(with_views(more=SYNC_LOG) + """SELECT run_id, cmd AS name, 'not supported' AS reason, count(*) AS n FROM log WHERE cmd = 'LPUSH' GROUP BY run_id, cmd
  UNION ALL SELECT 'run_0', NULL, 'InvalidInteger', 1 UNION ALL SELECT 'run_1', NULL, 'InvalidType', 1""")
def sync_unapplied(v):
    """What of that log is not applied, and why."""
    d = Y.unapplied(_sync_log(v)).withColumn("reason", F.substring_index("reason", ":", 1))
    return d.groupBy("run_id", "name", "reason").agg(F.count("*").alias("n"))


# Strings and hashes on few keys that are renamed again and again; the SQL takes one command after the other.
RENAME_LOG = """a AS (SELECT event_id AS seq, (event_id % 3)::INTEGER AS db, 'k' || (event_id * 7 % 23)::VARCHAR AS k, 'k' || (event_id * 5 % 19)::VARCHAR AS d, 'f' || (event_id % 4)::VARCHAR AS f, 'v' || event_id::VARCHAR AS v,
  ['SET', 'HSET', 'HSET', 'HDEL', 'DEL', 'EXPIRE', 'RENAME', 'RENAME'][event_id // 3 % 8 + 1] AS cmd FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY seq) AS i FROM a),
w AS (SELECT DISTINCT db, 0::BIGINT AS i, []::STRUCT(k VARCHAR, s VARCHAR, h STRUCT(f VARCHAR, v VARCHAR)[], e BIGINT)[] AS m FROM n
  UNION ALL
  SELECT db, i, CASE
    WHEN cmd = 'SET' THEN list_append(rest, {k: k, s: v, h: [], e: NULL})
    WHEN cmd = 'HSET' AND old.s IS NULL THEN list_append(rest, {k: k, s: NULL, h: list_append(coalesce(others, []), {f: f, v: v}), e: old.e})
    WHEN cmd = 'HDEL' AND old.k IS NOT NULL AND old.s IS NULL THEN CASE WHEN len(others) = 0 THEN rest ELSE list_append(rest, {k: k, s: NULL, h: others, e: old.e}) END
    WHEN cmd = 'DEL' THEN rest
    WHEN cmd = 'EXPIRE' AND old.k IS NOT NULL THEN list_append(rest, {k: k, s: old.s, h: old.h, e: NOW + seq * 1000})
    WHEN cmd = 'RENAME' AND k <> d THEN CASE WHEN old.k IS NULL THEN list_filter(rest, lambda x: x.k <> d) ELSE list_append(list_filter(rest, lambda x: x.k <> d), {k: d, s: old.s, h: old.h, e: old.e}) END
    ELSE m END
  FROM (SELECT *, list_filter(old.h, lambda x: x.f <> f) AS others FROM (
    SELECT n.*, w.m, list_filter(w.m, lambda x: x.k = n.k)[1] AS old, list_filter(w.m, lambda x: x.k <> n.k) AS rest FROM w JOIN n ON n.db = w.db AND n.i = w.i + 1))),
z AS (SELECT db, unnest(m) AS x FROM (SELECT db, arg_max(m, i) AS m FROM w GROUP BY db))""".replace("NOW", str(NOW_MS))


@query(with_views(more=RENAME_LOG, recursive=True) + """SELECT db, x.k AS key, NULL AS field, x.s AS value, x.e AS expire_ms FROM z WHERE x.s IS NOT NULL
  UNION ALL SELECT db, key, h.f, h.v, e FROM (SELECT db, x.k AS key, x.e AS e, unnest(x.h) AS h FROM z WHERE x.s IS NULL)""")
def sync_renames(v):
    """A log in which strings and hashes are renamed over and over, with their expiry, applied."""
    n = c("event_id")
    named = lambda prefix, x: F.concat(lit(prefix), x.cast("string"))
    k, d, f, val, m = named("k", n * 7 % 23), named("k", n * 5 % 19), named("f", n % 4), named("v", n), F.floor(n / 3) % 8
    args = (
        F.when(m == 0, F.array(k, val)).when(m.isin(1, 2), F.array(k, f, val)).when(m == 3, F.array(k, f)).when(m == 4, F.array(k))
        .when(m == 5, F.array(k, n.cast("string"))).otherwise(F.array(k, d))
    )
    name = F.get(F.array(*[lit(x) for x in ("SET", "HSET", "HSET", "HDEL", "DEL", "EXPIRE", "RENAME", "RENAME")]), m.cast("int"))
    log = v.table("events").select(lit("run_0").alias("run_id"), n.alias("seq"), (n % 3).cast("int").alias("db"), name.alias("name"), F.transform(args, lambda a: a.cast("binary")).alias("args"))
    empty = v.spark.createDataFrame([], "db int, key string, value string, expire_ms long")
    r = Y.apply(empty, log, NOW_MS)
    return r.select("db", *[c(x).cast("string").alias(x) for x in ("key", "field", "value")], "expire_ms")


# Elements --------------------------------------------------------------

ELEMENT_TYPES = (1, 10, 14, 18, 2, 11, 20, 3, 5, 12, 17, 4, 9, 13, 16)


@query(f"""WITH t AS (SELECT unnest([{", ".join(map(str, ELEMENT_TYPES))}]) AS rdb_type),
o AS (SELECT c_nationkey AS n, c_custkey, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer)
SELECT rdb_type, n || ':' || rdb_type AS key, CASE WHEN rdb_type IN (1, 10, 14, 18) THEN place END AS place, CASE WHEN rdb_type IN (4, 9, 13, 16) THEN c_name END AS field,
  CASE WHEN rdb_type IN (2, 11, 20, 4, 9, 13, 16) THEN (c_custkey * 31 - 20000)::VARCHAR ELSE c_name END AS value, CASE WHEN rdb_type IN (3, 5, 12, 17) THEN c_acctbal END AS score FROM o, t""")
def value_elements(v):
    """Collections of all customers of a nation in every encoding, through snapshot files, element by element."""
    per = v.table("customer").groupBy(c("c_nationkey").alias("n")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("all"))
    d = per.select("n", F.explode(F.array(*[lit(t) for t in ELEMENT_TYPES])).alias("rdb_type"), "all")
    kind, number = c("rdb_type"), lambda x: (x["c_custkey"] * 31 - 20000).cast("string")
    item = lambda x, i: F.struct(
        i.alias("place"), x["c_name"].cast("binary").alias("field"), F.when(kind.isin(2, 11, 20, 4, 9, 13, 16), number(x)).otherwise(x["c_name"]).cast("binary").alias("value"), x["c_acctbal"].alias("score"))
    d = d.select("n", "rdb_type", F.concat(c("n").cast("string"), lit(":"), kind.cast("string")).alias("key"), F.transform("all", item).alias("items"))
    raw = X.pack_values(d, "n", "key")
    rows = raw.select(F.concat(lit("run_"), (c("n") % 3).cast("string")).alias("run_id"), F.struct("n", "key").alias("pos"), (c("n") % 2).alias("db"), "key", "raw_value", lit(None).cast("long").alias("expire_ms"), "rdb_type", lit(None).cast("binary").alias("lead"))
    base = shared_folder(v.spark, "elements")
    _spark_writes(G.write_snapshots(rows, base))
    found = X.explode_values(rdb.read_snapshots(v.spark, base, check_crc=True))
    return found.select("rdb_type", *[c(x).cast("string").alias(x) for x in ("key", "field", "value")], c("place").cast("long").alias("place"), "score")


@query(with_views("commands", more=f"""n AS (SELECT run_id, seq, (epoch_us(ts) // 1000) AS at_ms, row_number() OVER (PARTITION BY run_id ORDER BY (epoch_us(ts) // 1000), seq) AS i FROM commands),
w AS (SELECT run_id, i, seq, at_ms, at_ms AS last, true AS due FROM n WHERE i = 1
  UNION ALL
  SELECT n.run_id, n.i, n.seq, n.at_ms, CASE WHEN n.at_ms - w.last >= {ACK_MS} THEN n.at_ms ELSE w.last END, n.at_ms - w.last >= {ACK_MS} FROM w JOIN n ON n.run_id = w.run_id AND n.i = w.i + 1)""", recursive=True)
       + "SELECT run_id, seq, at_ms FROM w WHERE due")
def ack_cadence(v):
    return S.cadence(v.commands.select("run_id", "seq", F.unix_millis("ts").alias("at_ms")), ACK_MS)


MULTI_KEY = "m AS (SELECT seq, db, ['MSET', 'DEL', 'RENAME'][seq % 3 + 1] AS cmd, ['user:' || (seq % 50), 'temp:' || (seq % 7), 'order:' || (seq % 11)] AS ks FROM commands)"


@query(with_views("commands", more=MULTI_KEY) + """SELECT cmd, db, count(*) AS n FROM m WHERE db NOT IN (2) AND CASE cmd
  WHEN 'MSET' THEN starts_with(ks[1], 'user:1') OR starts_with(ks[3], 'user:1') WHEN 'RENAME' THEN starts_with(ks[1], 'user:1') OR starts_with(ks[2], 'user:1')
  ELSE starts_with(ks[1], 'user:1') OR starts_with(ks[2], 'user:1') OR starts_with(ks[3], 'user:1') END = false GROUP BY cmd, db""")
def filter_all_keys(v):
    """A command goes if any of its keys is dropped; MSET's keys are every other argument."""
    key = lambda p, n: F.concat(lit(p), (c("seq") % n).cast("string"))
    cmd = F.get(F.array(lit("MSET"), lit("DEL"), lit("RENAME")), (c("seq") % 3).cast("int"))
    d = v.commands.select("db", cmd.alias("cmd"), F.array(key("user:", 50), key("temp:", 7), key("order:", 11)).alias("args"))
    rules = U.RuleSet(db_black=(2,), prefix_black=("user:1",))
    return d.filter(rules.keeps_all_keys(c("cmd"), c("args"), c("db"))).groupBy("cmd", "db").agg(F.count("*").alias("n"))

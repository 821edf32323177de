"""Registered queries over the replication relations and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom import config
from kvloom.functions import constants as C
from kvloom.functions import hashing as H
from kvloom.functions import snapshot_types as T
from kvloom.functions import sql
from kvloom.functions import wire as W
from kvloom.operators import ranges as R
from kvloom.operators import replay as P
from kvloom.operators import rules as U
from kvloom.operators import segments as S
from kvloom.operators import state as A
from kvloom.operators.prefix_sum import numbered
from kvloom.plans.views import NOW, NOW_MS, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# SQL forms of the hash functions ---------------------------------------

BYTES = "list_transform(range(1, strlen({k}) + 1), lambda i: ascii({k}[i]))"
CRC_TABLE = "[" + ", ".join(map(str, H.crc16_table())) + "]"
TAG = (
    "CASE WHEN instr({k}, '{{') > 0 AND instr(substr({k}, instr({k}, '{{') + 1), '}}') > 0 "
    "THEN substr({k}, instr({k}, '{{') + 1, instr(substr({k}, instr({k}, '{{') + 1), '}}') - 1) ELSE {k} END"
)


def crc16_sql(k: str) -> str:
    return (
        f"list_reduce(list_prepend(0, {BYTES.format(k=k)}), lambda crc, b: "
        f"xor((crc << 8) & 65535, ({CRC_TABLE})[xor(crc >> 8, b) + 1]))"
    )


def slot_cte(source: str) -> str:
    """CTE slots(key, tag, slot) of the distinct keys of a relation."""
    tags = f"tags AS (SELECT DISTINCT key, {TAG.format(k='key')} AS tag FROM {source} WHERE key IS NOT NULL)"
    return f"{tags}, slots AS (SELECT key, tag, ({crc16_sql('tag')} % 16384)::BIGINT AS slot FROM tags)"


FNV = (
    "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(key) + 1), lambda i: ascii(key[i])::UHUGEINT)), "
    "lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
)
ENCODED = "'*' || len(args) || chr(13) || chr(10) || array_to_string(list_transform(args, lambda a: '$' || strlen(a) || chr(13) || chr(10) || a || chr(13) || chr(10)), '')"
KEYS = "keys AS (SELECT DISTINCT key FROM commands WHERE key IS NOT NULL)"


def _keys(v: Views) -> DataFrame:
    return v.commands.filter(c("key").isNotNull()).select("key").distinct()


# Filters ---------------------------------------------------------------

DB_BLACK, CMD_BLACK = (1, 2), ("DEL", "FLUSHDB")
WHITE, BLACK = ("user:", "order:", "{user:"), ("temp:", "cache:", "order:1")
SLOT_WHITE, SLOT_BLACK = ((0, 5000), (4000, 12000)), ((100, 3000), (9000, 9500))
CONFIG = (
    '{"db_black_list": [3], "cmd_black_list": ["DEL"], "key_prefix_white_list": ["user:", "order:", "cache:"], '
    '"key_prefix_black_list": ["cache:"], "slot_white_list": [{"start": 0, "end": 9000}], "slot_black_list": [{"start": 2000, "end": 4000}]}'
)


def _counts(d: DataFrame) -> DataFrame:
    return d.groupBy("db", "cmd").agg(F.count("*").alias("n"))


def _kept(v: Views, rules: U.RuleSet) -> DataFrame:
    return _counts(v.commands.filter(~rules.drops(c("cmd"), c("key"), c("db"))))


def _count_sql(condition: str, views: str = "") -> str:
    return (views or with_views("commands")) + f"SELECT db, cmd, count(*) AS n FROM commands LEFT JOIN (SELECT key AS sk, slot FROM slots) ON key = sk WHERE {condition} GROUP BY db, cmd" if "slot" in condition else with_views("commands") + f"SELECT db, cmd, count(*) AS n FROM commands WHERE {condition} GROUP BY db, cmd"


ROUTED = f"cmd NOT IN ({_list(C.NO_ROUTE)})"
SLOTS = with_views("commands", more=slot_cte("commands"))
any_prefix = lambda ps: "(" + " OR ".join(f"starts_with(key, '{p}')" for p in ps) + ")"
any_range = lambda rs: "(" + " OR ".join(f"slot BETWEEN {a} AND {z}" for a, z in rs) + ")"


@query(_count_sql(f"{ROUTED} AND db NOT IN (1, 2)"))
def filter_db_blacklist(v):
    return _kept(v, U.RuleSet(db_black=DB_BLACK))


@query(_count_sql(f"{ROUTED} AND cmd NOT IN ({_list(CMD_BLACK)})"))
def filter_cmd_blacklist(v):
    return _kept(v, U.RuleSet(cmd_black=CMD_BLACK))


@query(_count_sql(ROUTED))
def filter_no_route(v):
    return _kept(v, U.RuleSet())


@query(with_views("txn_commands") + f"SELECT cmd, count(*) AS n FROM txn_commands WHERE cmd NOT IN ({_list(C.NO_ROUTE_STRICT)}) GROUP BY cmd")
def filter_no_route_strict(v):
    d = v.txn_commands.filter(~U.RuleSet(strict=True).drops(c("cmd"), lit(None).cast("string"), c("db")))
    return d.groupBy("cmd").agg(F.count("*").alias("n"))


@query(_count_sql(f"{ROUTED} AND (key IS NULL OR {any_prefix(WHITE)})"))
def filter_prefix_white(v):
    return _kept(v, U.RuleSet(prefix_white=WHITE))


@query(_count_sql(f"{ROUTED} AND (key IS NULL OR NOT {any_prefix(BLACK)})"))
def filter_prefix_black(v):
    return _kept(v, U.RuleSet(prefix_black=BLACK))


@query(_count_sql(f"{ROUTED} AND (key IS NULL OR {any_range(SLOT_WHITE)})", SLOTS))
def slot_white(v):
    return _kept(v, U.RuleSet(slot_white=SLOT_WHITE))


@query(_count_sql(f"{ROUTED} AND (key IS NULL OR NOT {any_range(SLOT_BLACK)})", SLOTS))
def slot_black(v):
    return _kept(v, U.RuleSet(slot_black=SLOT_BLACK))


ALL_RULES = U.RuleSet((1,), ("DEL",), ("user:", "order:", "cache:", "{user:"), ("cache:1", "order:2"), ((0, 12000),), ((3000, 6000),))
REASON = f"""CASE WHEN db IN (1) THEN 'db' WHEN cmd IN ('DEL') THEN 'cmd' WHEN cmd IN ({_list(C.NO_ROUTE)}) THEN 'no_route'
  WHEN key IS NULL THEN NULL
  WHEN NOT {any_prefix(ALL_RULES.prefix_white)} THEN 'prefix_white' WHEN {any_prefix(ALL_RULES.prefix_black)} THEN 'prefix_black'
  WHEN NOT {any_range(ALL_RULES.slot_white)} THEN 'slot_white' WHEN {any_range(ALL_RULES.slot_black)} THEN 'slot_black' END"""
JOINED = "FROM commands LEFT JOIN (SELECT key AS sk, slot FROM slots) ON key = sk"


@query(SLOTS + f"SELECT seq, run_id, db, cmd, key, ({REASON}) IS NOT NULL AS dropped {JOINED}")
def filter_combined(v):
    return v.commands.select("seq", "run_id", "db", "cmd", "key", ALL_RULES.drops(c("cmd"), c("key"), c("db")).alias("dropped"))


@query(SLOTS + f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n {JOINED} GROUP BY 1")
def filter_combined_reason(v):
    reason = F.coalesce(ALL_RULES.reason(c("cmd"), c("key"), c("db")), lit("kept"))
    return v.commands.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(SLOTS + f"""SELECT db, cmd, count(*) AS n {JOINED} WHERE db NOT IN (3) AND cmd NOT IN ('DEL') AND {ROUTED} AND (key IS NULL OR (
  {any_prefix(('user:', 'order:', 'cache:'))} AND NOT starts_with(key, 'cache:') AND slot BETWEEN 0 AND 9000 AND slot NOT BETWEEN 2000 AND 4000)) GROUP BY db, cmd""")
def filter_from_config(v):
    return _kept(v, U.RuleSet.from_config(CONFIG))


@query(with_views("commands", more=KEYS) + "SELECT key, key IN ('user:1', 'temp:2', 'cache:3', 'order:4') AS found FROM keys")
def trie_exact(v):
    return _keys(v).select("key", c("key").isin("user:1", "temp:2", "cache:3", "order:4").alias("found"))


PROBES = ("user:1", "user:14", "orders", "te", "", "{user:7}", "zzz", "cache:99")


@query(with_views("commands", more=KEYS) + f"SELECT p.probe, EXISTS (SELECT 1 FROM keys WHERE starts_with(key, p.probe)) AS found FROM (SELECT unnest([{_list(PROBES)}]) AS probe) p")
def trie_starts_with(v):
    probes = v.spark.createDataFrame([(p,) for p in PROBES], "probe string")
    return U.any_starts_with(_keys(v), probes)


@query(with_views("commands", more=KEYS) + f"SELECT key, {any_prefix(WHITE)} AS found FROM keys")
def trie_matches_prefix(v):
    return _keys(v).select("key", U.has_prefix(c("key"), list(WHITE)).alias("found"))


@query(with_views("commands", more=KEYS + ", prefixes AS (SELECT DISTINCT substr(key, 1, 6) AS prefix FROM keys WHERE starts_with(key, 'user:') OR starts_with(key, 'order:'))") + "SELECT key FROM keys WHERE EXISTS (SELECT 1 FROM prefixes WHERE starts_with(key, prefix))")
def trie_prefix_join(v):
    prefixes = _keys(v).filter(c("key").startswith("user:") | c("key").startswith("order:")).select(F.substring("key", 1, 6).alias("prefix"))
    return U.prefix_join(_keys(v), prefixes)


LONG_KEYS = """k AS (SELECT repeat(md5((c_custkey % 40)::VARCHAR), 7) || c_name AS key, c_custkey FROM customer),
p AS (SELECT DISTINCT substr(key, 1, (c_custkey * 7 % 200 + 1)::INTEGER) AS prefix FROM k WHERE c_custkey % 3 > 0 AND c_custkey % 40 <> 5)"""


@query(f"WITH {LONG_KEYS} SELECT key, max_by(prefix, length(prefix)) AS prefix FROM k LEFT JOIN p ON starts_with(key, prefix) GROUP BY key")
def longest_prefix(v):
    """Which rule of a table with prefixes of 1 to 200 characters is the longest that a key begins with."""
    key = F.concat(F.expr("repeat(md5(cast(c_custkey % 40 AS STRING)), 7)"), c("c_name"))
    d = v.table("customer").select("c_custkey", key.alias("key"))
    rules = d.filter((c("c_custkey") % 3 > 0) & (c("c_custkey") % 40 != 5)).select(F.substring(c("key"), lit(1), (c("c_custkey") * 7 % 200 + 1).cast("int")).alias("prefix"))
    return U.longest_prefix(d, rules)


@query(with_views("commands") + "SELECT run_id, count(key) = 0 AS is_empty FROM commands GROUP BY run_id")
def trie_is_empty(v):
    return v.commands.groupBy("run_id").agg((F.count("key") == 0).alias("is_empty"))


@query(with_views("keyspace") + """SELECT rdb_type, rdb_type IN (0) AS is_string, rdb_type IN (1, 10, 14, 18) AS is_list, rdb_type IN (2, 11, 20) AS is_set,
  rdb_type IN (3, 5, 12, 17) AS is_zset, rdb_type IN (4, 9, 13, 16) AS is_hash, rdb_type IN (9, 10, 11, 12, 13, 14, 16, 17, 18, 20) AS is_compressed, count(*) AS n
  FROM keyspace GROUP BY rdb_type""")
def type_predicates(v):
    kinds = [c("rdb_type").isin(*members).alias(f"is_{name}") for name, members in C.VALUE_CLASSES.items()]
    d = v.keyspace.groupBy("rdb_type").agg(F.count("*").alias("n"))
    return d.select("rdb_type", *kinds, T.is_compressed(c("rdb_type")).alias("is_compressed"), "n")


VALUES_SQL = """vals AS (SELECT seq, CASE seq % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'error' WHEN 2 THEN 'integer' WHEN 3 THEN 'bulk' ELSE 'null' END AS tag,
  CASE seq % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERR ' || cmd WHEN 2 THEN (seq - 500)::VARCHAR WHEN 3 THEN CASE WHEN seq % 2 = 0 THEN val ELSE '' END END AS text FROM commands),
raws AS (SELECT seq, tag, text, CASE tag WHEN 'simple' THEN '+' || text || chr(13) || chr(10) WHEN 'error' THEN '-' || text || chr(13) || chr(10)
  WHEN 'integer' THEN ':' || text || chr(13) || chr(10) WHEN 'bulk' THEN '$' || strlen(text) || chr(13) || chr(10) || text || chr(13) || chr(10)
  ELSE '$-1' || chr(13) || chr(10) END AS raw FROM vals)"""


def _values(v: Views) -> DataFrame:
    m = c("seq") % 5
    tag = F.when(m == 0, "simple").when(m == 1, "error").when(m == 2, "integer").when(m == 3, "bulk").otherwise("null")
    text = (
        F.when(m == 0, "OK").when(m == 1, F.concat(lit("ERR "), c("cmd"))).when(m == 2, (c("seq") - 500).cast("string"))
        .when(m == 3, F.when(c("seq") % 2 == 0, c("val")).otherwise(""))
    )
    return v.commands.select("seq", tag.alias("tag"), text.alias("text"))


@query(with_views("commands", more=VALUES_SQL) + "SELECT tag AS kind, raw = '+OK' || chr(13) || chr(10) AS is_ok, count(*) AS n FROM raws GROUP BY 1, 2")
def resp_predicates(v):
    raw = W.encode_value(c("tag"), c("text"))
    d = _values(v).select(raw.alias("raw"))
    return d.groupBy(W.kind_of(c("raw")).alias("kind"), (c("raw") == "+OK\r\n").alias("is_ok")).agg(F.count("*").alias("n"))


@query(with_views("commands", more=VALUES_SQL) + """SELECT seq, CASE tag WHEN 'simple' THEN '+' || text WHEN 'error' THEN '-' || text WHEN 'integer' THEN ':' || text
  WHEN 'bulk' THEN CASE WHEN text = '' THEN '$0' ELSE '$' || strlen(text) || ' (' || text || ')' END ELSE '$-1 (Null)' END AS shown FROM vals""")
def resp_display(v):
    return _values(v).select("seq", W.display_value(c("tag"), c("text")).alias("shown"))


@query(with_views("commands", more=VALUES_SQL) + "SELECT seq, raw FROM raws")
def resp_encode_values(v):
    return _values(v).select("seq", W.encode_value(c("tag"), c("text")).alias("raw"))


@query(with_views("commands", more=slot_cte("commands")) + "SELECT key, slot, slot BETWEEN 1000 AND 9000 AS inside FROM slots")
def slot_range_contains(v):
    d = _keys(v).withColumn("slot", H.key_slot(c("key")).cast("long"))
    return d.withColumn("inside", c("slot").between(1000, 9000))


@query(with_views("keyspace") + "SELECT db, count(*) AS n FROM keyspace WHERE rdb_type NOT IN (6, 22) AND length(value) > 0 GROUP BY db")
def snapshot_row_skip(v):
    d = v.keyspace.withColumn("raw_value", c("value").cast("binary"))
    return P.replayable(d).groupBy("db").agg(F.count("*").alias("n"))


# Functions in SQL text -------------------------------------------------


@query(with_views("commands", more=slot_cte("commands")) + f"""SELECT s.key, s.tag, s.slot, ({FNV})::VARCHAR AS fnv, ({FNV} % 7::UHUGEINT)::BIGINT AS worker,
  {any_prefix(('user:', 'order:'))} AS listed, s.slot BETWEEN 100 AND 4000 OR s.slot BETWEEN 9000 AND 9999 AS in_range FROM slots s""")
def sql_functions(v):
    """The library's functions called in SQL text."""
    sql.register(v.spark)
    _keys(v).createOrReplaceTempView("kvloom_keys")
    return v.spark.sql("""SELECT key, hash_tag(key) AS tag, cast(key_slot(key) AS BIGINT) AS slot, cast(fnv1a(key) AS STRING) AS fnv, worker_index(key, 7) AS worker,
      has_prefix(key, array('user:', 'order:')) AS listed, in_ranges(key_slot(key), array(struct(100, 4000), struct(9000, 9999))) AS in_range FROM kvloom_keys""")


@query(with_views("commands", more=f"e AS (SELECT seq, {ENCODED} AS raw FROM commands)") + "SELECT seq, raw, ['string', 'list', 'set', 'zset', 'hash', 'zset', 'other', NULL, NULL, 'hash', 'list'][seq % 11 + 1] AS value_class FROM e")
def sql_encode(v):
    """Commands encoded, and type bytes classed, in SQL text."""
    sql.register(v.spark)
    v.commands.select("seq", "args").createOrReplaceTempView("kvloom_commands")
    return v.spark.sql("SELECT seq, resp_encode(args) AS raw, rdb_value_class(cast(seq % 11 AS INT)) AS value_class FROM kvloom_commands")


# Scalar functions ------------------------------------------------------


@query(with_views("commands", more=slot_cte("commands")) + "SELECT key, tag, slot FROM slots")
def key_slot(v):
    return _keys(v).select("key", H.hash_tag(c("key")).alias("tag"), H.key_slot(c("key")).cast("long").alias("slot"))


@query(with_views("commands", more=slot_cte("commands")) + "SELECT DISTINCT tag FROM slots")
def hash_tag(v):
    return _keys(v).select(H.hash_tag(c("key")).alias("tag")).distinct()


@query(f"SELECT c_name, ({crc16_sql('c_name')})::BIGINT AS crc FROM customer")
def crc16(v):
    return v.table("customer").select("c_name", H.crc16(c("c_name")).cast("long").alias("crc"))


@query(with_views("commands", more=KEYS) + f"SELECT key, ({FNV})::VARCHAR AS fnv FROM keys")
def fnv_hash(v):
    return _keys(v).select("key", H.fnv_decimal(H.fnv1a(c("key"))).cast("string").alias("fnv"))


@query(with_views("commands", more=KEYS) + f"SELECT key, ({FNV} % 7::UHUGEINT)::BIGINT AS worker FROM keys")
def worker_index(v):
    return _keys(v).select("key", H.worker_index(H.fnv1a(c("key")), 7).alias("worker"))


@query(with_views("commands") + f"SELECT ({FNV} % 4::UHUGEINT)::BIGINT AS worker, count(*) AS n FROM commands WHERE key IS NOT NULL GROUP BY 1")
def worker_distribution(v):
    d = v.commands.filter(c("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"))
    return d.groupBy(H.worker_index(H.fnv1a(c("key")), 4).alias("worker")).agg(F.sum("n").alias("n"))


CRC64_TABLE = "[" + ", ".join(f"{x}::UBIGINT" for x in H.crc64_table()) + "]"


def crc64_sql(data: str) -> str:
    """Hexadecimal digits, least byte first, of the CRC-64 of a list of byte values."""
    crc = f"list_reduce(list_prepend(0::UBIGINT, list_transform({data}, lambda b: b::UBIGINT)), lambda crc, b: xor(crc >> 8, ({CRC64_TABLE})[(xor(crc, b) & 255)::BIGINT + 1]))"
    return f"(SELECT array_to_string(list_transform(range(8), lambda i: printf('%02X', ((x >> (8 * i)::UBIGINT) & 255)::BIGINT)), '') FROM (SELECT {crc} AS x))"


@query(f"SELECT c_name, {crc64_sql(BYTES.format(k='c_name'))} AS crc64 FROM customer")
def crc64(v):
    return v.table("customer").select("c_name", F.hex(H.crc64(c("c_name").cast("binary"))).alias("crc64"))


def _position_sql() -> str:
    return "CASE cmd " + " ".join(f"WHEN '{n}' THEN {list(at)}" for n, at in C.KEY_POSITIONS.items()) + " END"


NAMES = [*C.KEY_POSITIONS, "UNKNOWNCMD"]


@query(f"""WITH e AS (SELECT event_id AS seq, ([{_list(NAMES)}])[event_id % {len(NAMES)} + 1] AS cmd, ['a' || event_id, 'b' || user_id, event_type, 'd', 'e' || event_id % 7, 'f', 'g' || user_id] AS args FROM events),
p AS (SELECT *, {_position_sql()} AS places FROM e)
SELECT seq, cmd, places::VARCHAR AS positions, array_to_string(list_transform(list_filter(places, lambda i: i > 0), lambda i: args[i]), ',') AS keys FROM p""")
def key_positions(v):
    """Places and keys of every known command and an unknown one, over all events."""
    cmd = F.get(F.array(*[lit(n) for n in NAMES]), (c("event_id") % len(NAMES)).cast("int"))
    s = lambda p, x: F.concat(lit(p), x.cast("string"))
    args = F.array(s("a", c("event_id")), s("b", c("user_id")), c("event_type"), lit("d"), s("e", c("event_id") % 7), lit("f"), s("g", c("user_id")))
    at = W.key_positions(c("cmd"))
    shown = F.when(at.isNotNull(), F.concat(lit("["), F.array_join(at.cast("array<string>"), ", "), lit("]")))
    d = v.table("events").select(c("event_id").alias("seq"), cmd.alias("cmd"), args.alias("args"))
    return d.select("seq", "cmd", shown.alias("positions"), F.array_join(W.command_keys(c("cmd"), c("args")), ",").alias("keys"))


@query(with_views("commands") + "SELECT seq, CASE WHEN cmd IN ('SET', 'GET', 'HSET') THEN args[2] WHEN cmd = 'DEL' THEN args[2] END AS first_key, CASE WHEN cmd = 'CONFIG' THEN NULL ELSE 1 END AS n_keys FROM commands")
def command_keys(v):
    keys = W.command_keys(c("cmd"), F.slice("args", 2, F.size("args")))
    return v.commands.select("seq", F.get(keys, lit(0)).alias("first_key"), F.when(keys.isNotNull(), F.size(keys)).alias("n_keys"))


@query(with_views("commands") + "SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE cmd END AS name, CASE WHEN seq % 9 = 0 THEN NULL ELSE len(args) - 1 - CASE WHEN seq % 4 = 1 THEN 1 ELSE 0 END END AS n_args FROM commands")
def as_command(v):
    """Elements as tagged values: in some rows the name is an integer, in some the last argument is."""
    elements = F.transform(c("args"), lambda x, i: F.struct(
        F.when(((i == 0) & (c("seq") % 9 == 0)) | ((i == F.size("args") - 1) & (i > 0) & (c("seq") % 4 == 1)), "integer").otherwise("bulk").alias("tag"), x.alias("text")))
    name, args = W.as_command(elements)
    return v.commands.select("seq", name.alias("name"), F.when(args.isNotNull(), F.size(args).cast("long")).alias("n_args"))


@query(with_views("keyspace") + f"SELECT key, db, CASE WHEN expire > TIMESTAMP '{NOW}' THEN epoch_ms(expire) - epoch_ms(TIMESTAMP '{NOW}') ELSE 0 END AS ttl, coalesce(expire <= TIMESTAMP '{NOW}', false) AS is_expired FROM keyspace")
def ttl_ms(v):
    now = lit(NOW).cast("timestamp")
    return v.keyspace.select("key", "db", T.ttl_ms(c("expire"), now).alias("ttl"), T.is_expired(c("expire"), now).alias("is_expired"))


@query("SELECT o_orderkey, o_orderkey * 1000 + 77 AS from_ms, o_orderkey * 60 AS from_s FROM orders")
def expire_times(v):
    back = lambda ts, unit: unit(ts)
    return v.table("orders").select(
        "o_orderkey", back(T.expire_from_ms(c("o_orderkey") * 1000 + 77), F.unix_millis).alias("from_ms"),
        back(T.expire_from_seconds(c("o_orderkey") * 60), F.unix_seconds).alias("from_s"),
    )


@query("SELECT b AS type_byte, CASE b " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in C.VALUE_TYPES.items()) + " END AS type_name, CASE "
       + " ".join(f"WHEN b IN ({', '.join(map(str, m))}) THEN '{n}'" for n, m in C.VALUE_CLASSES.items()) + f" WHEN b IN ({', '.join(map(str, C.VALUE_TYPES))}) THEN 'other' END AS value_class, count(*) AS n FROM (SELECT o_orderkey % 30 AS b FROM orders) GROUP BY b")
def type_from_byte(v):
    d = v.table("orders").select((c("o_orderkey") % 30).alias("type_byte")).groupBy("type_byte").agg(F.count("*").alias("n"))
    return d.select("type_byte", "n", T.type_name(c("type_byte")).alias("type_name"), T.value_class(c("type_byte")).alias("value_class"))


@query(with_views("keyspace") + "SELECT CASE rdb_type WHEN 0 THEN 'string' WHEN 1 THEN 'list' WHEN 2 THEN 'set' WHEN 4 THEN 'hash' ELSE 'zset' END AS value_class, db, count(*) AS n, count(expire) AS n_expiring FROM keyspace GROUP BY 1, 2")
def value_class_counts(v):
    return v.keyspace.groupBy(T.value_class(c("rdb_type")).alias("value_class"), "db").agg(F.count("*").alias("n"), F.count("expire").alias("n_expiring"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 2 = 0 THEN 'rdb' ELSE 'aof' END AS kind, CASE WHEN p_partkey % 5 <> 4 THEN p_partkey * 100 END AS \"offset\", CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 2 = 0 THEN p_size END::BIGINT AS size FROM part")
def segment_parse(v):
    """Names built and parsed back; every fifth is spoilt."""
    k = c("p_partkey")
    name = S.segment_name(F.when(k % 2 == 0, "rdb").otherwise("aof"), k * 100, c("p_size"))
    kind, offset, size = S.parse_name(c("name"))
    d = v.table("part").select("p_partkey", F.when(k % 5 == 4, F.concat(lit("x"), name)).otherwise(name).alias("name"))
    return d.select("p_partkey", kind.alias("kind"), offset.alias("offset"), size.alias("size"))


RESERVED = "['kvloom_checkpoint', 'kvloom_circle_', 'kvloom_delay_', 'kvloom_election_', 'kvloo_', 'user:']"


@query(f"""WITH k AS (SELECT c_custkey, ({RESERVED})[c_custkey % 6 + 1] || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS key FROM customer)
SELECT key, key LIKE 'kvloom@_%' ESCAPE '@' AS reserved, count(*) AS n FROM k GROUP BY key""")
def reserved_keys(v):
    """Keys of every reserved kind and others."""
    prefix = F.get(F.array(*[lit(A.reserved_key(k)) for k in C.RESERVED_KINDS], lit("kvloo_"), lit("user:")), (c("c_custkey") % 6).cast("int"))
    d = v.table("customer").select(F.concat(prefix, F.when(c("c_custkey") % 6 == 0, "").otherwise(c("c_name"))).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("n")).select("key", A.is_reserved(c("key")).alias("reserved"), "n")


@query("""SELECT b AS code, CASE WHEN b <= 5 THEN ['Started', 'FullInit', 'FullSyncing', 'FullSynced', 'IncrSyncing', 'IncrSynced'][b + 1] ELSE 'Started' END AS phase,
  CASE WHEN b <= 5 THEN b ELSE 0 END AS back, CASE WHEN b <= 3 THEN ['ReadyRun', 'Run', 'Pause', 'Stop'][b + 1] ELSE 'ReadyRun' END AS state,
  CASE WHEN b = 1 THEN 'Follower' ELSE 'Leader' END AS role, count(*) AS n FROM (SELECT event_id % 256 AS b FROM events) GROUP BY b""")
def enum_codecs(v):
    name = T.phase_name(c("code"))
    return v.table("events").select((c("event_id") % 256).alias("code")).groupBy("code").agg(F.count("*").alias("n")).select(
        "code", "n", name.alias("phase"), T.phase_code(name).cast("long").alias("back"), T.code_name(c("code"), C.STATES).alias("state"), T.code_name(c("code"), C.ROLES).alias("role")
    )


@query("SELECT c_custkey, md5(c_name) AS replid FROM customer")
def parse_info(v):
    t = F.concat(lit("# Replication\r\nrole:master\r\nmaster_replid:"), F.md5(c("c_name").cast("binary")), lit("\r\nmaster_repl_offset:7\r\n"))
    return v.table("customer").select("c_custkey", A.parse_info(t).alias("replid"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'continue' END AS action, CASE o_orderkey % 3 WHEN 0 THEN 'id' || o_custkey::VARCHAR END AS replid, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey END AS \"offset\" FROM orders")
def psync_reply(v):
    line = F.when(c("o_orderkey") % 3 == 0, F.concat(lit("+FULLRESYNC id"), c("o_custkey").cast("string"), lit(" "), c("o_orderkey").cast("string"))).when(c("o_orderkey") % 3 == 1, "+CONTINUE").otherwise("-ERR")
    d = v.table("orders").select("o_orderkey", A.parse_psync_reply(line).alias("r"))
    return d.select("o_orderkey", "r.action", "r.replid", "r.offset")


# Wire ------------------------------------------------------------------



@query(with_views("commands") + f"SELECT seq, {ENCODED} AS raw, wire_len FROM commands")
def resp_encode(v):
    return v.commands.select("seq", W.encode_command(c("args")).alias("raw"), W.wire_length(c("args")).alias("wire_len"))


@query(with_views("offsets") + "SELECT run_id, seq, start_offset, end_offset FROM offsets")
def resp_offsets(v):
    return v.offsets.select("run_id", "seq", "start_offset", "end_offset")


@query(with_views("commands") + "SELECT seq, cmd AS name, array_to_string(args[2:], '|') AS args FROM commands")
def resp_roundtrip(v):
    """Commands encoded, then decoded by the decoder."""
    from kvloom.sources.resp import decode_column

    d = v.commands.select("seq", W.encode_command(c("args")).cast("binary").alias("raw"))
    return decode_column(d, "raw").select("seq", "name", F.array_join(F.transform("args", lambda a: a.cast("string")), "|").alias("args"))


@query("SELECT c_custkey, octet_length(encode(c_name)) + CASE WHEN octet_length(encode(c_name)) < 64 THEN 1 ELSE 2 END AS n, CASE WHEN c_custkey < 64 THEN lpad(lower(to_hex(c_custkey)), 2, '0') WHEN c_custkey < 16384 THEN lower(to_hex(c_custkey + 16384)) ELSE '80' || lpad(lower(to_hex(c_custkey)), 8, '0') END AS length_hex FROM customer")
def rdb_length_encoding(v):
    return v.table("customer").select("c_custkey", F.octet_length(T.string_code(c("c_name"))).cast("long").alias("n"), F.lower(F.hex(T.length_code(c("c_custkey")))).alias("length_hex"))


# Segments --------------------------------------------------------------


@query(with_views("segments") + 'SELECT run_id, kind, "offset", size FROM segments')
def segment_catalogue(v):
    """Through file paths: names built, listed and parsed."""
    d = v.segments
    path = F.concat(lit("store/"), c("run_id"), lit("/"), S.segment_name(c("kind"), c("offset"), c("size")))
    files = d.select(path.alias("path"), c("size").alias("length"), c("created_at").alias("modificationTime"))
    bad = files.limit(1).select(lit("store/run_0/notes.txt").alias("path"), "length", "modificationTime")
    return S.catalogue(files.union(bad)).select("run_id", "kind", "offset", "size")


@query(with_views("segments", "probes") + """SELECT run_id, o, min(s."offset") AS "offset", min_by(size, s."offset") AS size FROM probes JOIN segments s USING (run_id)
  WHERE kind = 'rdb' AND s."offset" <= o AND o < s."offset" + size GROUP BY run_id, o""")
def find_snapshot(v):
    return S.find_snapshot(v.probes, v.segments)


LOG_AT = "logs AS (SELECT p.run_id, p.o, s.\"offset\", s.size FROM probes p ASOF JOIN (SELECT * FROM segments WHERE kind = 'aof') s ON p.run_id = s.run_id AND p.o >= s.\"offset\")"


@query(with_views("segments", "probes", more=LOG_AT) + 'SELECT run_id, o, "offset" FROM logs')
def find_log_asof(v):
    return S.find_log(v.probes, v.segments)


RESOLVED = """os AS (SELECT DISTINCT o FROM probes), rs AS (SELECT DISTINCT run_id FROM segments),
cand AS (
  SELECT o, s.run_id, 0 AS rank, kind, s."offset", size FROM os JOIN segments s ON kind = 'rdb' AND s."offset" <= o AND o < s."offset" + size
  UNION ALL
  SELECT o, run_id, 1, 'aof', "offset", size FROM (
    SELECT os.o, s.run_id, s."offset", s.size, row_number() OVER (PARTITION BY os.o, s.run_id ORDER BY s."offset" DESC) AS rn
    FROM os JOIN segments s ON kind = 'aof' AND s."offset" <= os.o) WHERE rn = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY run_id, rank, "offset") AS rn FROM cand) WHERE rn = 1)"""


@query(with_views("segments", "probes", more=RESOLVED) + 'SELECT o, run_id, kind, "offset", size FROM best')
def reader_resolution(v):
    return S.resolve_reader(v.probes, v.segments)


AVAILABLE = """os AS (SELECT DISTINCT o FROM probes),
last AS (SELECT os.o, s.run_id, max(s."offset") AS "offset" FROM os JOIN segments s ON kind = 'aof' AND s."offset" <= os.o GROUP BY os.o, s.run_id),
cand AS (
  SELECT o, s.run_id, 0 AS rank, kind, s."offset" + size - o AS n FROM os JOIN segments s ON kind = 'rdb' AND s."offset" <= o AND o < s."offset" + size
  UNION ALL
  SELECT o, last.run_id, 1, kind, s."offset" + size - o FROM last JOIN segments s ON kind = 'aof' AND s.run_id = last.run_id AND s."offset" = last."offset"),
best AS (SELECT o, arg_min(run_id, (run_id, rank)) AS run_id, arg_min(kind, (run_id, rank)) AS kind, arg_min(n, (run_id, rank)) AS n FROM cand WHERE n > 0 GROUP BY o)"""


@query(with_views("segments", "probes", more=AVAILABLE) + "SELECT os.o, run_id, kind, coalesce(n, 0) AS n_available FROM os LEFT JOIN best ON os.o = best.o")
def available_bytes(v):
    return S.available(v.probes, v.segments)


@query(with_views("segments") + 'SELECT run_id, kind, max("offset") AS "offset", max_by(size, "offset") AS size FROM segments GROUP BY run_id, kind')
def latest_segment(v):
    return S.latest(v.segments)


@query(with_views("segments") + "SELECT DISTINCT run_id FROM segments ORDER BY run_id")
def run_ids(v):
    return S.run_ids(v.segments).orderBy("run_id")


@query(with_views("segments") + "SELECT run_id, kind, \"offset\", size FROM segments UNION ALL SELECT 'run_9', 'aof', 5, 10 ORDER BY run_id, \"offset\"")
def segment_add(v):
    new = v.spark.createDataFrame([("run_9", "aof", 5, 10)], "run_id string, kind string, offset long, size long")
    return v.segments.select("run_id", "kind", "offset", "size").union(new).orderBy("run_id", "offset")


@query(with_views("segments") + "SELECT kind, count(*) AS n, sum(size)::BIGINT AS total FROM segments GROUP BY kind")
def store_sizes(v):
    return S.sizes(v.segments)


@query(with_views("segments", more="""t AS (SELECT sum(size) AS total FROM segments),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY "offset" DESC) AS rn FROM segments),
cand AS (SELECT *, coalesce(sum(size) OVER (ORDER BY created_at, run_id, kind, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked WHERE NOT (kind = 'aof' AND rn = 1))""")
       + 'SELECT run_id, kind, "offset", size FROM cand, t WHERE total - 100000 > 0 AND before < total - 100000')
def gc_victims(v):
    return S.victims(v.segments, 100_000).select("run_id", "kind", "offset", "size")


@query(with_views("offsets", more="""n AS (SELECT run_id, seq, wire_len, start_offset, end_offset, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM offsets),
w AS (SELECT run_id, i, seq, end_offset, 0::BIGINT AS seg FROM n WHERE i = 1
  UNION ALL
  SELECT n.run_id, n.i, n.seq, n.end_offset, CASE WHEN w.end_offset - w.seg >= 20000 THEN w.end_offset ELSE w.seg END FROM w JOIN n ON n.run_id = w.run_id AND n.i = w.i + 1)""", recursive=True)
       + "SELECT run_id, seg, count(*) AS n, min(seq) AS first_seq FROM w GROUP BY run_id, seg")
def log_rotation(v):
    d = S.rotate(v.offsets.select("run_id", "seq", c("wire_len").alias("size")), 20_000)
    return d.groupBy("run_id", "seg").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# Ranges ----------------------------------------------------------------

MERGED = """u AS (SELECT s, max(e) AS e FROM ranges GROUP BY s),
m AS (SELECT s, e, max(e) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (ORDER BY s) AS island FROM m),
merged AS (SELECT min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM i GROUP BY island)"""


@query(with_views("ranges", more=MERGED) + "SELECT s, e FROM merged")
def range_merge(v):
    return R.merge(v.ranges)


@query(with_views("ranges", more=MERGED) + "SELECT count(*) AS n_ranges, sum(e - s + 1)::BIGINT AS covered FROM merged")
def range_coverage(v):
    return R.coverage(R.merge(v.ranges))


@query(with_views("ranges", "commands", more=MERGED + ", " + slot_cte("commands")) + "SELECT key, slot % 600 AS slot, EXISTS (SELECT 1 FROM merged WHERE slot % 600 BETWEEN s AND e) AS inside FROM slots")
def range_list_contains(v):
    keys = _keys(v).select("key", (H.key_slot(c("key")) % 600).cast("long").alias("slot"))
    return R.contained(keys, R.merge(v.ranges), "slot")


# State -----------------------------------------------------------------

# One command after the other.
TXN = """i AS (SELECT run_id, seq, cmd, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM txn_commands),
st AS (SELECT run_id, i, seq, cmd, CASE WHEN cmd = 'MULTI' THEN 'Begin' ELSE 'No' END AS txn FROM i WHERE i = 1
  UNION ALL
  SELECT i.run_id, i.i, i.seq, i.cmd, CASE WHEN i.cmd = 'MULTI' THEN 'Begin' WHEN i.cmd = 'DISCARD' THEN CASE WHEN st.txn IN ('Begin', 'In') THEN 'No' ELSE st.txn END
    WHEN i.cmd = 'EXEC' THEN CASE WHEN st.txn = 'In' THEN 'Commit' ELSE st.txn END WHEN st.txn = 'Begin' THEN 'In' WHEN st.txn = 'Commit' THEN 'No' ELSE st.txn END
  FROM st JOIN i ON i.run_id = st.run_id AND i.i = st.i + 1)"""


@query(with_views("txn_commands", more=TXN, recursive=True) + "SELECT run_id, seq, txn, txn = 'In' AND cmd NOT IN ('MULTI', 'EXEC', 'DISCARD') AS in_txn FROM st")
def txn_status(v):
    return A.transaction_status(v.txn_commands.select("run_id", "seq", "cmd")).select("run_id", "seq", "txn", "in_txn")


LIFE = """l AS (SELECT event_id AS seq, 'job_' || user_id % 9 AS run_id, ['run', 'pause', 'resume', 'pause', 'run', 'stop', 'restart', 'resume'][CASE WHEN event_id % 31 = 5 THEN 6 WHEN event_id % 17 = 3 THEN 7 ELSE event_id * 3 % 5 + 1 END] AS cmd FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM l),
s AS (SELECT run_id, i, seq, cmd, CASE WHEN cmd IN ('run', 'restart') THEN 'Run' WHEN cmd = 'stop' THEN 'Stop' ELSE 'ReadyRun' END AS state, CASE WHEN cmd IN ('pause', 'resume') THEN 1 ELSE 0 END AS code FROM i WHERE i = 1
  UNION ALL SELECT i.run_id, i.i, i.seq, i.cmd,
    CASE i.cmd WHEN 'stop' THEN 'Stop' WHEN 'restart' THEN 'Run' WHEN 'run' THEN CASE WHEN s.state IN ('ReadyRun', 'Pause') THEN 'Run' ELSE s.state END
      WHEN 'pause' THEN CASE WHEN s.state = 'Run' THEN 'Pause' ELSE s.state END ELSE CASE WHEN s.state = 'Pause' THEN 'Run' ELSE s.state END END,
    CASE WHEN i.cmd IN ('stop', 'restart') OR (i.cmd = 'run' AND s.state IN ('ReadyRun', 'Pause')) OR (i.cmd = 'pause' AND s.state = 'Run') OR (i.cmd = 'resume' AND s.state = 'Pause') THEN 0 ELSE 1 END
  FROM s JOIN i ON i.run_id = s.run_id AND i.i = s.i + 1)"""


@query(with_views(more=LIFE, recursive=True) + "SELECT run_id, seq, cmd, state, code::BIGINT AS code FROM s")
def lifecycle(v):
    """The states that a script of control commands leads jobs through, and which commands are refused."""
    n = c("event_id")
    at = F.when(n % 31 == 5, 5).when(n % 17 == 3, 6).otherwise(n * 3 % 5).cast("int")
    cmd = F.get(F.array(*[lit(x) for x in ("run", "pause", "resume", "pause", "run", "stop", "restart", "resume")]), at)
    d = v.table("events").select(n.alias("seq"), F.concat(lit("job_"), (c("user_id") % 9).cast("string")).alias("run_id"), cmd.alias("cmd"))
    return A.lifecycle(d).select("run_id", "seq", "cmd", "state", c("code").cast("long").alias("code"))


CONFIG_TEXT = """x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 7 THEN '{"input": ' WHEN s_suppkey % 11 = 8 THEN '{"input": {"addresses": ["a:1"]}}' WHEN s_suppkey % 11 = 9 THEN '{"input": {"addresses": []}, "output": {"addresses": ["b:2"]}}'
    WHEN s_suppkey % 11 = 10 THEN '{"input": {"addresses": ["a:1"], "typo": 1}, "output": {"addresses": ["b:2"]}}'
    ELSE '{"input": {"addresses": ["a:1", "a:2"]}, "output": {"addresses": ["b:2"], "kind": "sentinel"}' || CASE WHEN s_suppkey % 3 = 0 THEN ', "replay": {"rdb_parallel": ' || s_suppkey || '}' ELSE '' END
      || CASE WHEN s_suppkey % 2 = 0 THEN ', "store": {"dir": "s' || s_suppkey || '", "max_size": ' || (s_suppkey % 4) * 100000000 || '}' ELSE '' END
      || CASE WHEN s_suppkey % 5 = 0 THEN ', "checkpoint_ms": ' || s_suppkey || ', "filter": {"db_black_list": [1, 2], "key_prefix_white_list": ["user:"]}' ELSE '' END || '}' END AS text FROM supplier),
e AS (SELECT *, CASE k % 11 WHEN 7 THEN 'no JSON' WHEN 8 THEN 'output is missing' WHEN 9 THEN 'input: addresses are empty' WHEN 10 THEN 'input: unknown typo'
    ELSE CASE WHEN k % 2 = 0 AND (k % 4) * 100000000 < 104857600 THEN 'max_size is below log_size' END END AS error FROM x)"""


@query("WITH " + CONFIG_TEXT + """ SELECT k, error, CASE WHEN error IS NULL THEN 2 END AS addresses, CASE WHEN error IS NULL THEN 'sentinel' END AS output_kind,
  CASE WHEN error IS NULL THEN CASE WHEN k % 3 = 0 THEN k ELSE 4 END END AS rdb_parallel, CASE WHEN error IS NULL THEN 65536 END AS batch_size,
  CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN '/base/s' || k ELSE '/tmp/kvloom-store' END END AS dir, CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN (k % 4) * 100000000 ELSE 1073741824 END END AS max_size,
  CASE WHEN error IS NULL THEN 104857600 END AS log_size, CASE WHEN error IS NULL THEN CASE WHEN k % 5 = 0 THEN k ELSE 5000 END END AS checkpoint_ms, CASE WHEN error IS NULL THEN CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END END AS rules FROM e""")
def config_load(v):
    """Configurations with their defaults filled in, or why they are refused."""
    k, s = c("s_suppkey"), lambda x: x.cast("string")
    good = F.concat(
        lit('{"input": {"addresses": ["a:1", "a:2"]}, "output": {"addresses": ["b:2"], "kind": "sentinel"}'),
        F.when(k % 3 == 0, F.concat(lit(', "replay": {"rdb_parallel": '), s(k), lit("}"))).otherwise(""),
        F.when(k % 2 == 0, F.concat(lit(', "store": {"dir": "s'), s(k), lit('", "max_size": '), s(k % 4 * 100_000_000), lit("}"))).otherwise(""),
        F.when(k % 5 == 0, F.concat(lit(', "checkpoint_ms": '), s(k), lit(', "filter": {"db_black_list": [1, 2], "key_prefix_white_list": ["user:"]}'))).otherwise(""), lit("}"))
    text = (
        F.when(k % 11 == 7, '{"input": ').when(k % 11 == 8, '{"input": {"addresses": ["a:1"]}}').when(k % 11 == 9, '{"input": {"addresses": []}, "output": {"addresses": ["b:2"]}}')
        .when(k % 11 == 10, '{"input": {"addresses": ["a:1"], "typo": 1}, "output": {"addresses": ["b:2"]}}').otherwise(good)
    )
    d = config.load_column(v.table("supplier").select(k.alias("k"), text.alias("text")), "text", "/base", "k")
    return d.select("k", "error", "output_kind", "dir", *[c(n).cast("long").alias(n) for n in ("addresses", "rdb_parallel", "batch_size", "max_size", "log_size", "checkpoint_ms", "rules")])


@query(with_views("commands") + "SELECT run_id, ['Started', 'FullInit', 'FullSyncing', 'FullSynced', 'IncrSyncing', 'IncrSynced'][CASE WHEN max_by(seq % 8, seq) > 5 THEN 1 ELSE max_by(seq % 8, seq) + 1 END] AS phase FROM commands GROUP BY run_id")
def phase_last(v):
    return A.last_phase(v.commands.select("run_id", "seq", (c("seq") % 8).alias("code"))).select("run_id", "phase")


LATEST = 'cp AS (SELECT replid, max_by("offset", seq) AS "offset", count(*) - 1 AS version, max_by(mtime, seq) AS mtime FROM saves GROUP BY replid)'


@query(with_views("saves", more=LATEST) + 'SELECT replid, "offset", version, mtime FROM cp')
def checkpoint_latest(v):
    return A.latest_checkpoints(v.saves)


@query(with_views("saves", more=LATEST) + """SELECT replid || '_offset' AS field, "offset"::VARCHAR AS value FROM cp UNION ALL SELECT replid || '_runid', replid FROM cp
  UNION ALL SELECT replid || '_version', version::VARCHAR FROM cp UNION ALL SELECT replid || '_mtime', mtime::VARCHAR FROM cp""")
def checkpoint_fields(v):
    return A.checkpoint_fields(A.latest_checkpoints(v.saves))


@query(with_views("saves", more=LATEST) + "SELECT replid, \"offset\", CASE WHEN replid <> 'run_1' THEN version END AS version, mtime, CASE WHEN replid = 'run_1' THEN 'version' END AS error FROM cp")
def checkpoint_parse(v):
    f = A.checkpoint_fields(A.latest_checkpoints(v.saves)).filter(c("field") != "run_1_version")
    return A.parse_fields(f)


@query(with_views("saves", more=LATEST) + """SELECT s.replid, CASE WHEN cp.replid IS NULL THEN 'full' ELSE 'partial' END AS action, coalesce(cp."offset", -1) AS "offset",
  CASE WHEN cp.replid IS NULL THEN 'PSYNC ? -1' ELSE 'PSYNC ' || s.replid || ' ' || cp."offset"::VARCHAR END AS command
  FROM (SELECT unnest(['run_0', 'run_1', 'run_2', 'run_7']) AS replid) s LEFT JOIN (SELECT * FROM cp WHERE replid IN ('run_0', 'run_2', 'run_8')) cp ON s.replid = cp.replid""")
def resume_decision(v):
    make = lambda ids: v.spark.createDataFrame([(i,) for i in ids], "replid string")
    return A.resume_decision(make(["run_0", "run_1", "run_2", "run_7"]), make(["run_0", "run_2", "run_8"]), A.latest_checkpoints(v.saves))


@query(with_views("saves", more=LATEST) + "SELECT replid, \"offset\" FROM cp WHERE replid IN ('run_0', 'run_2', 'run_8')")
def checkpoint_discovery(v):
    index = v.spark.createDataFrame([("run_0",), ("run_2",), ("run_8",)], "replid string")
    return A.known_checkpoints(index, A.latest_checkpoints(v.saves)).select("replid", "offset")


@query(with_views("commands", more="""n AS (SELECT run_id, seq, (epoch_us(ts) // 1000) AS at_ms, row_number() OVER (PARTITION BY run_id ORDER BY (epoch_us(ts) // 1000), seq) AS i FROM commands),
w AS (SELECT run_id, i, seq, at_ms, at_ms AS last, true AS due FROM n WHERE i = 1
  UNION ALL
  SELECT n.run_id, n.i, n.seq, n.at_ms, CASE WHEN n.at_ms - w.last >= 3600000 THEN n.at_ms ELSE w.last END, n.at_ms - w.last >= 3600000 FROM w JOIN n ON n.run_id = w.run_id AND n.i = w.i + 1)""", recursive=True)
       + "SELECT run_id, seq, at_ms FROM w WHERE due")
def checkpoint_cadence(v):
    return S.cadence(v.commands.select("run_id", "seq", F.unix_millis("ts").alias("at_ms")), 3_600_000)


# Replay ----------------------------------------------------------------

ORDERED = "ordered AS (SELECT key, db, rdb_type, expire, value, row_number() OVER (ORDER BY key) AS pos FROM keyspace)"
CODE_LEN = "CASE WHEN octet_length(encode(value)) < 64 THEN 1 WHEN octet_length(encode(value)) < 16384 THEN 2 ELSE 5 END"
PAYLOAD_LEN = f"octet_length(encode(value)) + {CODE_LEN} + 11"


def _ordered(v: Views) -> DataFrame:
    """The snapshot in file order; the position comes with the rows of a real snapshot file."""
    return numbered(v.keyspace, "key", "pos")


@query(with_views("keyspace", more=ORDERED + ", l AS (SELECT pos, db, lag(db, 1, 0) OVER (ORDER BY pos) AS was FROM ordered)") + "SELECT pos, db FROM l WHERE db <> was")
def select_switches(v):
    return P.select_switches(_ordered(v))


@query(with_views("keyspace") + f"SELECT key, db, {PAYLOAD_LEN} AS n FROM keyspace")
def dump_payload_len(v):
    return v.keyspace.select("key", "db", P.dump_length(P.string_raw(c("value"))).alias("n"))


# Bytes of a DUMP body: type, length code, value, version.
BODY = f"""list_concat([rdb_type], CASE WHEN strlen(value) < 64 THEN [strlen(value)] WHEN strlen(value) < 16384 THEN [64 + strlen(value) // 256, strlen(value) % 256]
  ELSE [128, strlen(value) // 16777216, strlen(value) // 65536 % 256, strlen(value) // 256 % 256, strlen(value) % 256] END, {BYTES.format(k='value')}, [9, 0])"""


@query(with_views("keyspace", more=f"b AS (SELECT key, db, {BODY} AS body FROM keyspace)")
       + f"SELECT key, db, array_to_string(list_transform(body, lambda b: printf('%02X', b::BIGINT)), '') || {crc64_sql('body')} AS payload FROM b")
def dump_payload(v):
    return v.keyspace.select("key", "db", F.hex(P.dump_payload(c("rdb_type"), P.string_raw(c("value")))).alias("payload"))


@query(with_views("keyspace", more=ORDERED + f", b AS (SELECT *, {BODY} AS body FROM ordered)") + f"""SELECT pos, db, 5 AS n_args, 'RESTORE' AS cmd, key,
  array_to_string(list_transform(body, lambda b: printf('%02X', b::BIGINT)), '') || {crc64_sql('body')} AS payload, CASE WHEN expire > TIMESTAMP '{NOW}' THEN epoch_ms(expire) - epoch_ms(TIMESTAMP '{NOW}') ELSE 0 END::VARCHAR AS ttl,
  {PAYLOAD_LEN} AS payload_len FROM b""")
def restore_commands(v):
    d = _ordered(v).withColumn("raw_value", P.string_raw(c("value")))
    out = P.restore_commands(d, lit(NOW).cast("timestamp"))
    at = lambda i: F.get("args", lit(i))
    return out.select("pos", "db", F.size("args").alias("n_args"), at(0).cast("string").alias("cmd"), at(1).cast("string").alias("key"), at(2).cast("string").alias("ttl"), F.hex(at(3)).alias("payload"), F.octet_length(at(3)).cast("long").alias("payload_len"))


@query(with_views("commands", "keyspace", more="""lg AS (SELECT db, key, val AS value, seq, cmd FROM commands WHERE cmd IN ('SET', 'HSET', 'DEL') AND key IS NOT NULL),
al AS (SELECT db, key, value, -1 AS seq, 'SET' AS cmd, 'snapshot' AS source FROM keyspace UNION ALL SELECT db, key, value, seq, cmd, 'log' FROM lg),
rk AS (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY seq DESC) AS rn FROM al)""") + "SELECT db, key, value, source FROM rk WHERE rn = 1 AND cmd <> 'DEL'")
def keyspace_after_log(v):
    return P.apply_log(v.keyspace, v.commands.withColumnRenamed("val", "value"))


METRIC_SQL = f"""m AS (SELECT ({NOW_MS} - max((epoch_us(ts) // 1000))) / 1000.0::DOUBLE AS sync_delay_seconds, 100.0::DOUBLE AS rdb_replay_progress, count(*) FILTER (WHERE NOT d) AS aof_commands_total,
  count(*) FILTER (WHERE d) AS filtered_commands_total, count(*) FILTER (WHERE seq % 50 = 0) AS sync_errors_total
  FROM (SELECT *, coalesce(cmd IN ({_list(C.NO_ROUTE)}) OR db IN (1), false) AS d FROM commands))"""


def _metrics(v: Views) -> DataFrame:
    return P.metrics(v.commands, U.RuleSet(db_black=(1,)).drops(c("cmd"), c("key"), c("db")), c("seq") % 50 == 0, NOW_MS, 100.0)


@query(with_views("commands", more=METRIC_SQL) + "SELECT * FROM m")
def sync_metrics(v):
    return _metrics(v)


GAUGE = "rtrim(rtrim(printf('%.6f', {0}), '0'), '.')"


@query(with_views("commands", more=METRIC_SQL) + " UNION ALL ".join(
    f"SELECT '{n}' AS name, '{n} ' || {GAUGE.format(n) if i < 2 else n} AS line FROM m" for i, n in enumerate(C.METRICS)))
def prometheus_text(v):
    return P.prometheus_text(_metrics(v))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept commands by database and command under a full rule set."""
    return _kept(Views(spark, sf_dir), ALL_RULES)


from kvloom import file_queries as _file_queries  # noqa: E402, F401  (registers more queries)

"""Fixed values of the protocol and of the filter rules."""

from __future__ import annotations

# Commands that are never forwarded (fixed values).
NO_ROUTE = ("AUTH", "REPLCONF", "PSYNC", "SYNC", "CLUSTER", "CONFIG", "DEBUG", "SHUTDOWN", "SLAVEOF", "MONITOR", "INFO")

# The stricter preset of never-forwarded commands (fixed values).
NO_ROUTE_STRICT = (
    "AUTH", "CLUSTER", "COMMAND", "CONFIG", "DEBUG", "FLUSHALL", "FLUSHDB", "INFO", "KEYS", "MONITOR", "PSYNC", "REPLCONF",
    "SYNC", "SHUTDOWN", "SLAVEOF", "SCRIPT", "SENTINEL",
)

# Argument places of keys by command, from 1; 0 says that the command has no key (fixed values).
KEY_POSITIONS: dict[str, tuple[int, ...]] = {
    "WAIT": (0,), "EVAL": (0,), "EVALSHA": (0,), "FCALL": (0,), "FCALL_RO": (0,), "EXEC": (0,), "DISCARD": (0,),
    "MULTI": (0,), "PING": (0,), "SELECT": (0,), "FLUSHDB": (0,), "FLUSHALL": (0,), "APPEND": (1,), "BITCOUNT": (1,),
    "BITFIELD": (1,), "BITPOS": (1,), "DECR": (1,), "DECRBY": (1,), "GET": (1,), "GETBIT": (1,), "GETDEL": (1,),
    "GETEX": (1,), "GETRANGE": (1,), "GETSET": (1,), "INCR": (1,), "INCRBY": (1,), "INCRBYFLOAT": (1,), "PSETEX": (1,),
    "SET": (1,), "SETBIT": (1,), "SETEX": (1,), "SETNX": (1,), "SETRANGE": (1,), "STRLEN": (1,), "SUBSTR": (1,),
    "HDEL": (1,), "HEXISTS": (1,), "HGET": (1,), "HGETALL": (1,), "HINCRBY": (1,), "HINCRBYFLOAT": (1,), "HKEYS": (1,),
    "HLEN": (1,), "HMGET": (1,), "HMSET": (1,), "HRANDFIELD": (1,), "HSCAN": (1,), "HSET": (1,), "HSETNX": (1,),
    "HSTRLEN": (1,), "HVALS": (1,), "LINDEX": (1,), "LINSERT": (1,), "LLEN": (1,), "LPOP": (1,), "LPOS": (1,),
    "LPUSH": (1,), "LPUSHX": (1,), "LRANGE": (1,), "LREM": (1,), "LSET": (1,), "LTRIM": (1,), "RPOP": (1,),
    "RPUSH": (1,), "RPUSHX": (1,), "SADD": (1,), "SCARD": (1,), "SISMEMBER": (1,), "SMEMBERS": (1,), "SMISMEMBER": (1,),
    "SPOP": (1,), "SRANDMEMBER": (1,), "SREM": (1,), "SSCAN": (1,), "ZADD": (1,), "ZCARD": (1,), "ZCOUNT": (1,),
    "ZDIFFSTORE": (1,), "ZINCRBY": (1,), "ZINTERSTORE": (1,), "ZLEXCOUNT": (1,), "ZMSCORE": (1,), "ZPOPMAX": (1,),
    "ZPOPMIN": (1,), "ZRANDMEMBER": (1,), "ZRANGE": (1,), "ZRANGEBYLEX": (1,), "ZRANGEBYSCORE": (1,), "ZRANK": (1,),
    "ZREM": (1,), "ZREMRANGEBYLEX": (1,), "ZREMRANGEBYRANK": (1,), "ZREMRANGEBYSCORE": (1,), "ZREVRANGE": (1,),
    "ZREVRANGEBYLEX": (1,), "ZREVRANGEBYSCORE": (1,), "ZREVRANK": (1,), "ZSCAN": (1,), "ZSCORE": (1,),
    "ZUNIONSTORE": (1,), "XACK": (1,), "XADD": (1,), "XAUTOCLAIM": (1,), "XCLAIM": (1,), "XDEL": (1,), "XGROUP": (1,),
    "XINFO": (1,), "XLEN": (1,), "XPENDING": (1,), "XRANGE": (1,), "XREVRANGE": (1,), "XSETID": (1,), "XTRIM": (1,),
    "DUMP": (1,), "EXPIRE": (1,), "EXPIREAT": (1,), "EXPIRETIME": (1,), "KEYS": (1,), "MIGRATE": (1,), "MOVE": (1,),
    "OBJECT": (1,), "PEXPIRE": (1,), "PEXPIREAT": (1,), "PEXPIRETIME": (1,), "PERSIST": (1,), "PSCAN": (1,),
    "PTTL": (1,), "RESTORE": (1,), "SCAN": (1,), "SORT": (1,), "SORT_RO": (1,), "TTL": (1,), "TYPE": (1,),
    "BLMOVE": (1, 2), "BLPOP": (1, 2), "BRPOP": (1, 2), "BRPOPLPUSH": (1, 2), "LMOVE": (1, 2), "RPOPLPUSH": (1, 2),
    "SMOVE": (1, 2), "COPY": (1, 2), "RENAME": (1, 2), "RENAMENX": (1, 2), "SDIFF": (1, 2, 3), "SDIFFSTORE": (1, 2, 3),
    "SINTER": (1, 2, 3), "SINTERSTORE": (1, 2, 3), "SUNION": (1, 2, 3), "SUNIONSTORE": (1, 2, 3), "DEL": (1, 2, 3),
    "EXISTS": (1, 2, 3), "TOUCH": (1, 2, 3), "UNLINK": (1, 2, 3), "MGET": (1, 2, 3, 4), "MSET": (1, 3, 5, 7),
    "MSETNX": (1, 3, 5, 7), "LMPOP": (2,), "SINTERCARD": (2,), "ZDIFF": (2,), "ZINTER": (2,), "ZINTERCARD": (2,),
    "ZUNION": (2,), "BITOP": (2, 3, 4), "BLMPOP": (3,), "XREAD": (3,), "XREADGROUP": (6,),
}

# Snapshot value types by type byte (fixed values).
VALUE_TYPES = {
    0: "String", 1: "List", 2: "Set", 3: "SortedSet", 4: "Hash", 5: "SortedSet2", 6: "Module", 9: "HashZipmap",
    10: "ListZiplist", 11: "SetIntset", 12: "SortedSetZiplist", 13: "HashZiplist", 14: "Quicklist", 15: "StreamListpacks",
    16: "HashListpack", 17: "SortedSetListpack", 18: "Quicklist2", 19: "StreamListpacks2", 20: "SetListpack",
    21: "StreamListpacks3", 22: "Module2",
}

# Classes of value types (fixed values).
VALUE_CLASSES = {
    "string": (0,),
    "list": (1, 10, 14, 18),
    "set": (2, 11, 20),
    "zset": (3, 5, 12, 17),
    "hash": (4, 9, 13, 16),
}
COMPRESSED_TYPES = (9, 10, 11, 12, 13, 14, 16, 17, 18, 20)
MODULE_TYPES = (6, 22)
STREAM_TYPES = (15, 19, 21)

# Codes of state enums; unknown codes read as the default, the first (fixed values).
PHASES = ("Started", "FullInit", "FullSyncing", "FullSynced", "IncrSyncing", "IncrSynced")

STATES = ("ReadyRun", "Run", "Pause", "Stop")
ROLES = ("Leader", "Follower")

# Metric names (fixed values).
METRICS = ("sync_delay_seconds", "rdb_replay_progress", "aof_commands_total", "filtered_commands_total", "sync_errors_total")

#: Prefix of keys that the engine writes for itself; checkpoint tables, loop marks, delay probes and leases.
RESERVED_PREFIX = "kvloom_"
RESERVED_KINDS = ("checkpoint", "circle_", "delay_", "election_")

SLOTS = 16384
LOG_SIZE = 100 << 20
STORE_SIZE = 1 << 30
CHECKPOINT_MS = 5000
ACK_MS = 10_000
DECODER_LIMIT = 100 << 20
MAX_ELEMENTS = 100_000_000

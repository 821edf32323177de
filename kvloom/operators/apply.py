"""Application of a command log: what each command does to which key, and the keyspace that results.

All is aggregation and joins, no fold: of a key counts the last command that
sets or deletes it as a whole, the last expiry, and of each field the last
command behind that. These are reduced with map-side combining; the few keys
with a large share of all commands meet their fields by broadcast, so that no
task has a key's commands together. Renamed keys are followed before: each
command belongs to a version of its key, a rename hands a version on, and
pointer jumping finds where it ends.

The log counts as a record of commands that were carried out: conditions (NX,
XX) have been met. Relative expiry counts from ``now_ms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.operators.prefix_sum import scan
from kvloom.sources.shared import written

#: Of all commands, the share from which on a key is met by broadcast: at most 1 / HOT_SHARE keys.
HOT_SHARE = 1 / 2000
# Commands that are applied, and commands that change nothing (fixed values).
APPLIED = (
    "SET", "SETEX", "PSETEX", "GETSET", "MSET", "DEL", "UNLINK", "HSET", "HMSET", "HDEL", "EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT", "PERSIST",
    "FLUSHDB", "FLUSHALL", "RENAME", "RENAMENX", "HSETNX", "SADD", "SREM", "SMOVE", "ZADD", "ZREM",
)
NO_CHANGE = (
    "SELECT", "PING", "GET", "MGET", "EXISTS", "TTL", "PTTL", "TYPE", "STRLEN", "HGET", "HGETALL", "HMGET", "HEXISTS", "HKEYS", "HVALS", "HLEN",
    "SMEMBERS", "SISMEMBER", "SCARD", "ZSCORE", "ZRANGE", "ZCARD", "ZRANK", "MULTI", "EXEC", "DISCARD", "REPLCONF", "INFO", "CONFIG", "AUTH", "CLUSTER", "DEBUG", "MONITOR", "SCAN", "KEYS",
)


def in_database(log: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """log (run_id, seq, name, args) with db: that of the last SELECT of its run; before the first that of carried (run_id, carried), a row for each run, or 0."""
    chosen = F.when(F.upper("name") == "SELECT", F.get("args", F.lit(0)).cast("string").try_cast("int"))
    d = scan(log, ["run_id"], "seq", {"db": ("last", chosen)})
    if carried is None:
        return d.withColumn("db", F.coalesce("db", F.lit(0)))
    return d.join(F.broadcast(carried), "run_id", "left").withColumn("db", F.coalesce("db", "carried", F.lit(0))).drop("carried")


def _at(i: int | Column) -> Column:
    return F.get("args", i if isinstance(i, Column) else F.lit(i))


def _number(x: Column) -> Column:
    return x.cast("string").try_cast("long")


def _option(word: str) -> Column:
    """The place of an option of SET among its arguments behind the value, from 1; 0 if it is not there."""
    return F.array_position(F.transform(F.slice("args", 3, F.greatest(F.size("args"), F.lit(1))), lambda a: F.upper(a.cast("string"))), word).cast("int")


def _given(word: str) -> Column:
    return _number(_at(_option(word) + 2))


def _first_score() -> Column:
    """The place of ZADD's first score, behind its options; null if there is none."""
    at = F.array_position(F.transform("args", lambda a, i: (i > 0) & a.cast("string").try_cast("double").isNotNull()), True).cast("int")
    return F.when(at > 0, at - 1)


def conditional() -> Column:
    """Whether a command holds for some of its elements only, by what was there before: these are not applied."""
    options = F.transform(F.slice("args", 2, F.greatest(F.coalesce(_first_score(), F.size("args")) - 1, F.lit(0))), lambda a: F.upper(a.cast("string")))
    return F.coalesce((F.upper("name") == "ZADD") & F.arrays_overlap(options, F.array(*[F.lit(o) for o in ("NX", "XX", "GT", "LT", "INCR")])), F.lit(False))


def malformed() -> Column:
    """Whether arguments of a command that apply() knows are missing or no numbers; such a command changes nothing."""
    name, size = F.upper("name"), F.coalesce(F.size("args"), F.lit(0))
    no_number = lambda i: _number(_at(i)).isNull()
    bad = F.when(name == "SET", (size < 2) | F.coalesce(*[F.when(_option(w) > 0, _given(w).isNull()) for w in ("EX", "PX", "EXAT", "PXAT")], F.lit(False)))
    bad = bad.when(name.isin("SETEX", "PSETEX"), (size != 3) | no_number(1)).when(name.isin("GETSET", "RENAME", "RENAMENX"), size < 2)
    bad = bad.when(name == "MSET", (size == 0) | (size % 2 == 1)).when(name.isin("DEL", "UNLINK", "PERSIST"), size < 1)
    bad = bad.when(name.isin("HSET", "HMSET"), (size < 3) | (size % 2 == 0)).when(name.isin("HDEL", "SADD", "SREM", "ZREM"), size < 2)
    bad = bad.when(name.isin("HSETNX", "SMOVE"), size != 3).when(name == "ZADD", _first_score().isNull() | ((size - _first_score()) % 2 == 1) | F.exists(
        F.filter("args", lambda a, i: (i >= _first_score()) & ((i - _first_score()) % 2 == 0)), lambda a: a.cast("string").try_cast("double").isNull()))
    bad = bad.when(name.isin("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"), (size < 2) | no_number(1)).otherwise(F.lit(False))
    return F.coalesce(bad, F.lit(True))


def _effect(op: str, key: Column, field: Column | None = None, value: Column | None = None, expire: Column | None = None, kind: str = "string") -> Column:
    none = F.lit(None).cast("binary")
    return F.struct(
        F.lit(op).alias("op"), F.lit(kind).alias("kind"), key.alias("key"), (none if field is None else field).alias("field"), (none if value is None else value).alias("value"),
        (F.lit(None).cast("long") if expire is None else expire).alias("expire_ms"),
    )


def _each_element(op: str, kind: str):
    return lambda i: _effect(op, _at(0), _at(i), kind=kind)


def effects(log: DataFrame, now_ms: int) -> DataFrame:
    """(run_id, seq, i, db, op, kind, key, field, value, expire_ms): one row for each key or element that a command of log (run_id, seq, db, name, args) touches.

    op: set, keep (a set that leaves the expiry), del, expire; hset and hdel for
    elements of kind hash, set or zset (a member is a field, its score the
    value); out and in for a rename's two keys, out with the new key as its field.
    """
    name, size = F.upper("name"), F.size("args")
    expire = (
        F.when(_option("EX") > 0, _given("EX") * 1000 + now_ms).when(_option("PX") > 0, _given("PX") + now_ms)
        .when(_option("EXAT") > 0, _given("EXAT") * 1000).when(_option("PXAT") > 0, _given("PXAT"))
    )
    every = lambda step, first, last: F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    second = _number(_at(1))
    until = {"EXPIRE": second * 1000 + now_ms, "PEXPIRE": second + now_ms, "EXPIREAT": second * 1000, "PEXPIREAT": second}
    one = lambda *e: F.array(*e)
    got = F.when((name == "SET") & (_option("KEEPTTL") > 0), one(_effect("keep", _at(0), value=_at(1))))
    got = got.when(name == "SET", one(_effect("set", _at(0), value=_at(1), expire=expire)))
    got = got.when(name == "SETEX", one(_effect("set", _at(0), value=_at(2), expire=second * 1000 + now_ms)))
    got = got.when(name == "PSETEX", one(_effect("set", _at(0), value=_at(2), expire=second + now_ms)))
    got = got.when(name == "GETSET", one(_effect("set", _at(0), value=_at(1))))
    got = got.when(name == "MSET", F.transform(every(2, F.lit(0), size - 2), lambda i: _effect("set", _at(i), value=_at(i + 1))))
    got = got.when(name.isin("DEL", "UNLINK"), F.transform("args", lambda k: _effect("del", k)))
    got = got.when(name.isin("HSET", "HMSET"), F.transform(every(2, F.lit(1), size - 2), lambda i: _effect("hset", _at(0), _at(i), _at(i + 1), kind="hash")))
    got = got.when(name == "HSETNX", one(_effect("hset", _at(0), _at(1), _at(2), kind="hash")))
    for n, op, kind in (("HDEL", "hdel", "hash"), ("SADD", "hset", "set"), ("SREM", "hdel", "set"), ("ZREM", "hdel", "zset")):
        got = got.when(name == n, F.transform(every(1, F.lit(1), size - 1), _each_element(op, kind)))
    got = got.when(name == "SMOVE", one(_effect("hdel", _at(0), _at(2), kind="set"), _effect("hset", _at(1), _at(2), kind="set")))
    got = got.when(name == "ZADD", F.transform(every(2, _first_score(), size - 2), lambda i: _effect("hset", _at(0), _at(i + 1), _at(i), kind="zset")))
    got = got.when(name.isin("RENAME", "RENAMENX") & (_at(0) != _at(1)), one(_effect("out", _at(0), _at(1)), _effect("in", _at(1))))
    for n, ms in until.items():
        got = got.when(name == n, one(_effect("expire", _at(0), expire=ms)))
    got = got.when(name == "PERSIST", one(_effect("expire", _at(0))))
    rows = log.filter(name.isin(*APPLIED) & ~name.isin("FLUSHDB", "FLUSHALL") & ~malformed() & ~conditional())
    rows = rows.select("run_id", "seq", "db", F.posexplode(got).alias("i", "e"))
    return rows.select("run_id", "seq", "i", "db", "e.*").filter(F.col("key").isNotNull())


#: The place of what is there before all commands, and of what is there before a snapshot.
LOADED, BEFORE = -1, -2


def _operations(snapshot: DataFrame, log: DataFrame, now_ms: int) -> DataFrame:
    """(db, key, place, i, op, kind, field, value, expire_ms, source, run_id, seq) of snapshot and log, without what a later flush takes away.

    Runs follow one another by run_id: place is seq behind all runs before.
    """
    # Read several times, and dear to decode.
    log = written(log.select("run_id", "seq", "db", "name", "args").filter(F.upper("name").isin(*APPLIED)), "log")
    ends = log.groupBy("run_id").agg(F.max("seq").alias("last"))  # a row for each run
    base = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(ends.select("run_id", base.alias("base")))
    field = F.col("field").cast("binary") if "field" in snapshot.columns else F.lit(None).cast("binary")
    given = F.col("kind") if "kind" in snapshot.columns else F.when(field.isNull(), "string").otherwise("hash")
    none = lambda kind: F.lit(None).cast(kind)
    first = snapshot.select("db", F.col("key").cast("binary").alias("key"), F.lit(LOADED).cast("long").alias("place"), F.lit(0).alias("i"), F.when(field.isNull(), "load").otherwise("hload").alias("op"),
                            given.alias("kind"), field.alias("field"), F.col("value").cast("binary").alias("value"), "expire_ms", F.lit("snapshot").alias("source"), none("string").alias("run_id"), none("long").alias("seq"))
    place = (F.col("base") + F.col("seq")).alias("place")
    found = effects(log, now_ms).join(bases, "run_id").select("*", place, F.lit("log").alias("source"))
    rows = written(first.unionByName(found.select(*first.columns)), "operations")
    # A row for each database that is flushed, and one for all.
    flushes = log.filter(F.upper("name").isin("FLUSHDB", "FLUSHALL")).join(bases, "run_id").select("db", "name", place)
    last = flushes.groupBy(F.when(F.upper("name") == "FLUSHDB", F.col("db")).otherwise(-1).alias("flushed")).agg(F.max("place").alias("at"))
    for name, of in (("own", F.col("db")), ("every", F.lit(-1))):
        rows = rows.join(F.broadcast(last.select(F.col("flushed").alias("of"), F.col("at").alias(name))), of == F.col("of"), "left").drop("of")
    return rows.filter(F.col("place") > F.coalesce(F.greatest("own", "every"), F.lit(BEFORE))).drop("own", "every")


def _here() -> Column:
    """A row's place in the order of all operations."""
    return F.struct("place", "i")


def _met(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows joined with keys (db, key, n, more), a row for each key: those with more than HOT_SHARE of all n by broadcast."""
    limit = (keys.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(keys.filter(F.col("n") > limit).drop("n"))
    is_hot = F.broadcast(keys.filter(F.col("n") > limit).select("db", "key"))
    cold = rows.join(is_hot, ["db", "key"], "left_anti").join(keys.filter(F.col("n") <= limit).drop("n"), ["db", "key"])
    return cold.unionByName(rows.join(hot, ["db", "key"]))


def follow_renames(rows: DataFrame) -> DataFrame:
    """rows (db, key, place, i, op, ...) without renames: what moved has the key that it ends at, what a rename overwrote is left out.

    A version of a key lasts from one command that makes the key anew (load, set,
    del, in, out) to the next. A rename hands the version before it on to the
    version that begins there; versions that are handed on again and again are
    followed in as many joins as the longest chain has binary digits.
    """
    moves = rows.filter(F.col("op").isin("in", "out"))
    if moves.isEmpty():
        return rows
    whole = F.col("op").isin("load", "set", "del", "in", "out")
    d = scan(rows, ["db", "key"], "place", {"version": ("max", F.when(whole, _here()))}, tie=(F.col("i"),), exclusive=True)
    none = F.struct(F.lit(BEFORE).cast("long").alias("place"), F.lit(0).alias("i"))
    before = F.coalesce("version", none)
    d = written(d.withColumn("version", F.when(whole & (F.col("op") != "out"), _here()).otherwise(before)), "versions")
    target = F.struct(F.col("place"), (F.col("i") + 1).alias("i"))
    edges = d.filter("op = 'out'").select("db", "key", "version", F.col("field").alias("to_key"), target.alias("to"))
    edges = written(edges, "moves")
    while True:
        on = edges.select("db", F.col("key").alias("to_key"), F.col("version").alias("to"), F.col("to_key").alias("next_key"), F.col("to").alias("next"))
        further = edges.join(on, ["db", "to_key", "to"], "left")
        further = written(further.select("db", "key", "version", F.coalesce("next_key", "to_key").alias("to_key"), F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("went")), "moves")
        edges = further.drop("went")
        if further.filter("went").isEmpty():
            break
    last = moves.groupBy("db", "key").agg(F.max(_here()).alias("moved"))
    # What a later rename overwrote: a chain that ends in a version which is not the last, and commands before a rename that no chain takes along.
    edges = edges.join(last.select("db", F.col("key").alias("to_key"), "moved"), ["db", "to_key"]).withColumn("lost", F.col("moved") > F.col("to")).drop("moved", "to")
    d = d.filter("op NOT IN ('in', 'out')").join(edges, ["db", "key", "version"], "left").join(last, ["db", "key"], "left")
    kept = F.when(F.col("to_key").isNotNull(), ~F.col("lost")).otherwise(F.col("moved").isNull() | (_here() > F.col("moved")))
    return written(d.filter(kept).withColumn("key", F.coalesce("to_key", "key")).drop("version", "to_key", "lost", "moved"), "followed")


FIELD_OPS = ("hset", "hload", "hdel")
STRING_OPS = ("load", "set", "keep")


def _keys(rows: DataFrame) -> DataFrame:
    """(db, key, n, whole, made, expiry): of each key the number of operations, the last that sets or deletes it, the last such that also says its expiry, and the last expiry."""
    op = F.col("op")
    what = F.struct(F.col("place"), F.col("i"), "op", "kind", "value", "expire_ms", "source")
    return rows.groupBy("db", "key").agg(
        F.count("*").alias("n"), F.max_by(what, F.when(op.isin("load", "set", "keep", "del"), _here())).alias("whole"),
        F.max_by(what, F.when(op.isin("load", "set", "del"), _here())).alias("made"), F.max_by(what, F.when(op.isin("expire", "hload"), _here())).alias("expiry"),
    )


def _place(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.place").alias("place"), F.col(f"{c}.i").alias("i")))


def _alive(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(db, key, alive): whether keys (db, key, made, expiry) have been there from their last expiry on, by how many fields they had after each command."""
    none = F.struct(F.lit(BEFORE).cast("long").alias("place"), F.lit(0).alias("i"))
    events = rows.filter(F.col("op").isin(*FIELD_OPS, "keep")).select("db", "key", "place", "i", "op", "kind", F.coalesce("field", F.lit(b"")).alias("field"), (F.col("op") == "keep").alias("whole"))
    events = _met(events, keys.select("db", "key", "n", F.coalesce(_place("made"), none).alias("from"), _place("expiry").alias("since"))).filter(_here() > F.col("from"))
    span = int(rows.agg(F.max(F.abs("place"))).first()[0] or 0)
    there = F.col("op") != "hdel"
    d = scan(events, ["db", "key", "whole", "kind", "field"], "place", {"was": ("last", there)}, tie=(F.col("i"),), exclusive=True, span=span)
    step = there.cast("int") - F.coalesce("was", F.lit(False)).cast("int")
    d = scan(d.withColumn("step", step), ["db", "key"], "place", {"n_fields": ("sum", F.col("step"))}, tie=(F.col("i"),), span=span)
    now = F.max_by("n_fields", F.when(_here() <= F.col("since"), _here()))
    return d.groupBy("db", "key").agg((F.coalesce(now, F.lit(0)) > 0).alias("then"), F.max((_here() > F.col("since")) & (F.col("n_fields") == 0)).alias("gone")).select("db", "key", (F.col("then") & ~F.col("gone")).alias("alive"))


def _resolved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, fields): each key's state with its expiry, and each field's last operation behind the last that set or deleted its key."""
    keys = written(_keys(rows), "keys")
    none = F.struct(F.lit(BEFORE).cast("long").alias("place"), F.lit(0).alias("i"))
    own = rows.filter(F.col("op").isin(*FIELD_OPS)).select("db", "key", "place", "i", "op", "kind", "field", "value", "source")
    own = _met(own, keys.select("db", "key", "n", F.coalesce(_place("whole"), none).alias("from"), _place("expiry").alias("since")))
    own = own.filter(_here() > F.col("from"))
    then = F.max_by("op", F.when(_here() <= F.col("since"), _here())).isin("hset", "hload")
    fields = own.groupBy("db", "key", "kind", "field").agg(
        F.max_by(F.struct("op", "value", "source"), _here()).alias("f"),
        F.coalesce(then & (F.count_if((_here() > F.col("since")) & (F.col("op") == "hdel")) == 0), F.lit(False)).alias("stays"), F.count("*").alias("n"),
    )
    fields = written(fields.select("db", "key", "kind", "field", "f.*", "stays", "n"), "fields")
    hashes = fields.groupBy("db", "key").agg(F.max("stays").alias("stays"), F.max(F.col("op") != "hdel").alias("fields"))
    d = keys.join(hashes, ["db", "key"], "left")
    string = F.coalesce(F.col("whole.op").isin(*STRING_OPS), F.lit(False))
    # An expiry says something if it comes after the key was made.
    said = F.coalesce(_place("expiry") > F.coalesce(_place("made"), none), F.lit(False))
    made = F.coalesce(F.col("made.op").isin("load", "set"), F.lit(False))
    sure = made | (string & (_place("expiry") > _place("whole"))) | (~string & F.coalesce("stays", F.lit(False)))
    d = d.withColumns({"string": string, "said": said, "sure": F.coalesce(sure, F.lit(False))})
    d = d.filter("string OR fields")
    open_ = d.filter("said AND NOT sure AND expiry.expire_ms IS NOT NULL")
    if not open_.isEmpty():
        d = d.join(_alive(rows, open_), ["db", "key"], "left").withColumn("sure", F.col("sure") | F.coalesce("alive", F.lit(False)))
    expire = F.when(F.col("said") & F.col("sure"), F.col("expiry.expire_ms")).when(made, F.col("made.expire_ms"))
    return d.select("db", "key", "string", "fields", "n", F.col("whole.kind").alias("kind"), F.col("whole.value").alias("value"), F.col("whole.source").alias("source"), expire.alias("expire_ms")), fields


def apply(snapshot: DataFrame, log: DataFrame, now_ms: int) -> DataFrame:
    """(db, key, kind, field, value, expire_ms, source): the keyspace after the log, a row for each string, raw value or element.

    Elements are fields of hashes with their values, members of sets without,
    and members of sorted sets with their scores. snapshot: (db, key, value,
    expire_ms) and, where collections are decoded, field and kind; field is null
    for strings and values that stay as they are (kind list). log: (run_id, seq, db,
    name, args); runs follow one another by run_id. source tells whether a value
    comes from the snapshot or the log. Keys whose expiry has passed stay, with
    that expiry. Malformed commands change nothing, nor do field commands on
    strings and raw values; unapplied() lists both.
    """
    rows = follow_renames(_operations(snapshot, log, now_ms))
    keys, fields = _resolved(rows)
    keys = written(keys, "keyspace")
    strings = keys.filter("string").select("db", "key", "kind", F.lit(None).cast("binary").alias("field"), "value", "expire_ms", "source")
    live = fields.filter("op <> 'hdel'").select("db", "key", "kind", "field", "value", "source")
    hashes = _met(live, keys.filter("NOT string").select("db", "key", "n", "expire_ms"))
    return strings.unionByName(hashes.select(*strings.columns))


def unapplied(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(run_id, seq, name, reason) of what is in the log but not in the keyspace: malformed bytes and arguments, commands that apply() does
    not know, and, with the snapshot, field commands whose key was a string or a raw value when they came and still is."""
    name = F.upper("name")
    reason = F.when(F.col("_error").isNotNull(), F.col("_error")).when(~name.isin(*APPLIED, *NO_CHANGE), F.lit("not supported"))
    reason = reason.when(name.isin(*APPLIED) & malformed(), F.lit("malformed arguments")).when(conditional(), F.lit("not supported"))
    out = log.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("run_id", "seq", "name", "reason")
    if snapshot is None:
        return out
    rows = follow_renames(_operations(snapshot, log.filter(F.col("_error").isNull()), 0))
    strings = _keys(rows).filter(F.col("whole.op").isin(*STRING_OPS)).select("db", "key", "n", _place("whole").alias("from"))
    wrong = _met(rows.filter(F.col("op").isin("hset", "hdel")).select("db", "key", "place", "i", "run_id", "seq"), strings).filter(_here() > F.col("from"))
    wrong = wrong.select("run_id", "seq").distinct().join(log.select("run_id", "seq", "name"), ["run_id", "seq"])
    return out.unionByName(wrong.select("run_id", "seq", "name", F.lit("wrong type").alias("reason")))

"""Transactions, phases, checkpoints and resume decisions over ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions.constants import RESERVED_PREFIX
from kvloom.functions.snapshot_types import phase_code, phase_name
from kvloom.operators.prefix_sum import scan


def transaction_status(commands: DataFrame) -> DataFrame:
    """commands (run_id, seq, cmd) with txn (No, Begin, In, Commit) and in_txn after each command.

    Closed form, no fold: a MULTI opens a group, which ends at the first DISCARD,
    or EXEC after an ordinary command. Two prefix scans carry what a command must
    know: the last MULTI and the last ordinary command, then the first end in the
    latest group. A log without transactions, or with one that stays open, is
    scanned like any other.
    """
    seq, cmd = F.col("seq"), F.col("cmd")
    ordinary = ~cmd.isin("MULTI", "EXEC", "DISCARD")
    span = int(commands.agg(F.max(F.abs("seq"))).first()[0] or 0)
    d = scan(commands, ["run_id"], "seq", {"__multi": ("max", F.when(cmd == "MULTI", seq)), "__last": ("max", F.when(ordinary, seq))}, span=span)
    begun = F.coalesce(F.col("__last") > F.col("__multi"), F.lit(False))
    ends = (cmd == "DISCARD") | ((cmd == "EXEC") & begun)
    # The greatest is of the latest group, and the first there.
    end = F.when(ends & F.col("__multi").isNotNull(), F.struct(F.col("__multi").alias("multi"), (-seq).alias("at"), (cmd == "DISCARD").alias("gone")))
    d = scan(d, ["run_id"], "seq", {"__end": ("max", end)}, span=span)
    ended = F.coalesce(F.col("__end.multi") == F.col("__multi"), F.lit(False))
    status = (
        F.when(F.col("__multi").isNull(), "No").when(~ended, F.when(begun, "In").otherwise("Begin"))
        .when(F.col("__end.gone") | (F.col("__last") > -F.col("__end.at")), "No").otherwise("Commit")
    )
    return d.withColumn("txn", status).withColumn("in_txn", ordinary & (F.col("txn") == "In")).drop("__multi", "__last", "__end")


def lifecycle(commands: DataFrame) -> DataFrame:
    """commands (run_id, seq, cmd: run, pause, resume, stop or restart) with state after each and code: 0 if it was taken, 1 if refused.

    Closed form by one prefix scan: stop and restart set the state whatever it
    was; behind a restart, or the first run if there is none, the last of run,
    resume and pause decides; a stopped job stays so until a restart.
    """
    seq, cmd = F.col("seq"), F.col("cmd")
    place = F.struct(seq.alias("at"), cmd.alias("cmd"))
    values = {
        "__set": ("max", F.when(cmd.isin("stop", "restart"), place)), "__moved": ("max", F.when(cmd.isin("run", "resume", "pause"), place)),
        "__begun": ("min", F.when(cmd == "run", seq)),
    }
    d = scan(commands, ["run_id"], "seq", values, exclusive=True)
    set_, moved, begun = F.col("__set"), F.col("__moved"), F.col("__begun")
    start = F.when(set_["cmd"] == "restart", set_["at"]).otherwise(begun)
    before = (
        F.when(F.coalesce(set_["cmd"] == "stop", F.lit(False)), "Stop").when(start.isNull(), "ReadyRun")
        .when((moved["at"] >= start) & (moved["cmd"] == "pause"), "Pause").otherwise("Run")
    )
    taken = (
        cmd.isin("stop", "restart") | ((cmd == "run") & before.isin("ReadyRun", "Pause")) | ((cmd == "pause") & (before == "Run")) | ((cmd == "resume") & (before == "Pause"))
    )
    after = F.when(~taken, before).when(cmd == "stop", "Stop").when(cmd == "pause", "Pause").otherwise("Run")
    return d.withColumn("state", after).withColumn("code", F.when(taken, 0).otherwise(1)).drop("__set", "__moved", "__begun")


def last_phase(events: DataFrame) -> DataFrame:
    """(run_id, phase, code) of the last phase event (run_id, seq, code) of each run."""
    last = events.groupBy("run_id").agg(F.max_by("code", "seq").alias("code"))
    name = phase_name(F.col("code"))
    return last.select("run_id", name.alias("phase"), phase_code(name).alias("code"))


def latest_checkpoints(saves: DataFrame) -> DataFrame:
    """(replid, offset, version, mtime): last save of each replication id; every save after the first adds one to the version."""
    return saves.groupBy("replid").agg(
        F.max_by("offset", "seq").alias("offset"), (F.count("*") - 1).alias("version"), F.max_by("mtime", "seq").alias("mtime")
    )


def checkpoint_fields(checkpoints: DataFrame) -> DataFrame:
    """(field, value): checkpoints as the fields of one hash."""
    each = F.array(*[
        F.struct(F.concat("replid", F.lit(suffix)).alias("field"), value.cast("string").alias("value"))
        for suffix, value in (("_offset", F.col("offset")), ("_runid", F.col("replid")), ("_version", F.col("version")), ("_mtime", F.col("mtime")))
    ])
    return checkpoints.select(F.explode(each).alias("f")).select("f.field", "f.value")


def parse_fields(fields: DataFrame) -> DataFrame:
    """(replid, offset, version, mtime, error) from hash fields; error names the first field that is missing or no number."""
    cut = F.regexp_extract("field", r"^(.*)_(offset|runid|version|mtime)$", 1)
    kind = F.regexp_extract("field", r"^(.*)_(offset|runid|version|mtime)$", 2)
    wide = fields.select(cut.alias("replid"), kind.alias("kind"), "value").filter(kind != "").groupBy("replid").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("offset", "version", "mtime")]
    )
    number = {k: F.col(k).try_cast("long") for k in ("offset", "version", "mtime")}
    error = F
    for k, n in number.items():
        error = error.when(n.isNull(), F.lit(k))
    return wide.select("replid", *[n.alias(k) for k, n in number.items()], error.alias("error"))


def reserved_key(kind: str, prefix: str = RESERVED_PREFIX) -> str:
    return f"{prefix}{kind}"


def is_reserved(key: Column, prefix: str = RESERVED_PREFIX) -> Column:
    return key.startswith(prefix)


def known_checkpoints(index: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints whose replication id is indexed."""
    return checkpoints.join(index.select("replid").distinct(), "replid")


def resume_decision(sources: DataFrame, index: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(replid, action, offset, command): partial resync where the id is indexed and has an offset, else full."""
    found = known_checkpoints(index, checkpoints).select("replid", F.col("offset").alias("saved"))
    d = sources.select("replid").join(found, "replid", "left")
    go = F.col("saved").isNotNull()
    return d.select(
        "replid", F.when(go, "partial").otherwise("full").alias("action"), F.coalesce("saved", F.lit(-1)).alias("offset"),
        F.when(go, F.concat(F.lit("PSYNC "), "replid", F.lit(" "), F.col("saved").cast("string"))).otherwise("PSYNC ? -1").alias("command"),
    )


def parse_info(text: Column) -> Column:
    """Replication id in the text of an info reply; null if absent."""
    found = F.regexp_extract(text, r"(?m)^master_replid:([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def parse_psync_reply(line: Column) -> Column:
    """struct<action, replid, offset> of +FULLRESYNC id offset or +CONTINUE [id]; null otherwise."""
    part = lambda i: F.get(F.split(F.btrim(line, F.lit("+\r\n ")), " "), F.lit(i))
    full = F.struct(F.lit("full").alias("action"), part(1).alias("replid"), part(2).try_cast("long").alias("offset"))
    go = F.struct(F.lit("continue").alias("action"), part(1).alias("replid"), F.lit(None).cast("long").alias("offset"))
    return F.when(line.startswith("+FULLRESYNC"), full).when(line.startswith("+CONTINUE"), go)

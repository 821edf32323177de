"""Snapshot-then-log replay as a controllable Structured Streaming job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import elements, wire
from kvloom.functions.constants import PHASES, STATES, STORE_SIZE
from kvloom.operators import apply, segments
from kvloom.operators.rules import RuleSet
from kvloom.sources import rdb, resp
from kvloom.sources.shared import written

COLUMNS = ("run_id", "seq", "db", "name", "args", "_error", "end_offset")
SAVED = "run_id string, offset long, db int, applied long, filtered long, errors long, batch long"


class SyncJob:
    """Applies base's snapshots, then its logs as they grow, to a keyspace table.

    run / stop / pause / resume / restart / status / metrics / gc answer with
    {code, message, data}. Progress survives restarts: Spark's own checkpoint
    holds the log offsets, and each micro-batch writes its result under its
    batch id, so a batch that runs again replaces its own output.
    """

    def __init__(self, spark: SparkSession, base: str, out: str, rules: RuleSet | None = None, checkpoint_ms: int | None = None):
        self.spark, self.base, self.out, self.rules, self.every = spark, base, out, rules or RuleSet(), checkpoint_ms
        self.state, self.phase, self.query = STATES[0], PHASES[0], None
        resp.register(spark)

    def _answer(self, code: int = 0, message: str = "ok", data=None) -> dict:
        return {"code": code, "message": message, "data": data}

    def _log(self, stream: bool) -> DataFrame:
        """(run_id, seq, name, args, _error, end_offset)."""
        log = self.spark.readStream.format("respLog").option("path", self.base).load() if stream else resp.read_logs(self.spark, self.base)
        return log.select("run_id", F.col("start_offset").alias("seq"), "name", "args", "_error", "end_offset")

    def _with_drops(self, rows: DataFrame) -> DataFrame:
        cmd = F.upper("name")
        keys = wire.command_keys(cmd, F.transform("args", lambda a: a.cast("string")))
        # Of commands that take any number of keys, all count: DEL and UNLINK every argument, MSET every other.
        keys = F.when(cmd.isin("DEL", "UNLINK"), F.transform("args", lambda a: a.cast("string"))).when(
            cmd == "MSET", F.transform(F.filter("args", lambda a, i: i % 2 == 0), lambda a: a.cast("string"))
        ).otherwise(keys)
        dropped = F.col("_error").isNull() & ~self.rules.keeps_all_keys(cmd, keys, F.col("db"))
        return rows.select(*COLUMNS).withColumn("dropped", dropped)

    def commands(self) -> DataFrame:
        """The logs as they are now, as (run_id, seq, db, name, args, _error, end_offset, dropped). A command is dropped if the rules drop any of its keys."""
        return self._with_drops(apply.in_database(self._log(stream=False)))

    def _saved(self) -> DataFrame | None:
        """(batch, run_id, offset, db, counts): what each micro-batch has saved of each run; None before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/checkpoints")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.option("basePath", f"{self.out}/checkpoints").schema(SAVED).parquet(f"{self.out}/checkpoints")

    def _save(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: databases by a scan over its commands, with what earlier batches carry on; a batch that runs again replaces its own output."""
        saved = self._saved()
        carried = None if saved is None else saved.filter(F.col("batch") < batch_id).groupBy("run_id").agg(F.max_by("db", F.when(F.col("db").isNotNull(), F.col("batch"))).alias("carried"))
        rows = self._with_drops(apply.in_database(written(batch, "batch"), carried))
        rows.write.mode("overwrite").parquet(f"{self.out}/log/batch={batch_id}")
        rows, failed = self.spark.read.schema(rows.schema).parquet(f"{self.out}/log/batch={batch_id}"), F.col("_error").isNotNull()
        rows.groupBy("run_id").agg(
            F.max("end_offset").alias("offset"), F.max_by("db", "seq").alias("db"), F.count_if(~F.col("dropped") & ~failed).alias("applied"),
            F.count_if("dropped").alias("filtered"), F.count_if(failed).alias("errors"),
        ).write.mode("overwrite").parquet(f"{self.out}/checkpoints/batch={batch_id}")

    def run(self) -> dict:
        if self.state not in ("ReadyRun", "Pause"):
            return self._answer(1, f"cannot run in {self.state}")
        if self.state == "ReadyRun":
            self.phase = "FullSyncing"
            elements.entries(rdb.read_snapshots(self.spark, self.base)).write.mode("overwrite").parquet(f"{self.out}/snapshot")
            self.phase = "FullSynced"

        writer = self._log(stream=True).writeStream.foreachBatch(self._save).option("checkpointLocation", f"{self.out}/stream")
        writer = writer.trigger(processingTime=f"{self.every} milliseconds") if self.every else writer.trigger(availableNow=True)
        self.query, self.state, self.phase = writer.start(), "Run", "IncrSyncing"
        return self._answer()

    def wait(self) -> None:
        if self.query:
            if self.every:
                self.query.processAllAvailable()
            else:
                self.query.awaitTermination()
            self.phase = "IncrSynced"

    def _end(self) -> None:
        if self.query and self.query.isActive:
            self.query.stop()

    def pause(self) -> dict:
        if self.state != "Run":
            return self._answer(1, f"cannot pause in {self.state}")
        self._end()
        self.state = "Pause"
        return self._answer()

    def resume(self) -> dict:
        return self.run() if self.state == "Pause" else self._answer(1, f"cannot resume in {self.state}")

    def stop(self) -> dict:
        self._end()
        self.state = "Stop"
        return self._answer()

    def restart(self) -> dict:
        self._end()
        self.state = "Pause"
        return self.run()

    def status(self) -> dict:
        return self._answer(data={"state": self.state, "phase": self.phase, "active": bool(self.query and self.query.isActive)})

    def health(self) -> dict:
        return self._answer(data="healthy")

    def log_level(self, level: str) -> dict:
        if level.upper() not in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR"):
            return self._answer(1, f"unknown level {level}")
        self.spark.sparkContext.setLogLevel(level.upper())
        return self._answer()

    def keyspace(self, now_ms: int | None = None) -> DataFrame:
        """The keyspace as far as the job came: (db, key, field, value, expire_ms, source), all bytes as they are. Values of other than strings
        and hashes stay encoded. now_ms: the clock of relative expiry."""
        snap = self.spark.read.parquet(f"{self.out}/snapshot")
        log = self.spark.read.parquet(f"{self.out}/log").filter("NOT dropped")
        return apply.apply(snap, log, int(time.time() * 1000) if now_ms is None else now_ms)

    def unapplied(self) -> DataFrame:
        """(run_id, seq, name, reason) of malformed bytes and of commands that the keyspace lacks."""
        return apply.unapplied(self.spark.read.parquet(f"{self.out}/log").filter("NOT dropped"), self.spark.read.parquet(f"{self.out}/snapshot"))

    def checkpoints(self) -> DataFrame:
        """(run_id, offset): the last saved log offset of each run."""
        return self._saved().groupBy("run_id").agg(F.max("offset").alias("offset"))

    def metrics(self) -> dict:
        """Sums over what the micro-batches have counted; the log is not read again."""
        sums = [F.sum("applied").alias("aof_commands_total"), F.sum("filtered").alias("filtered_commands_total"), F.sum("errors").alias("sync_errors_total")]
        return self._answer(data=self._saved().agg(*sums, F.max("offset").alias("offset")).first().asDict())

    def gc(self, limit: int = STORE_SIZE) -> DataFrame:
        """Segments that have to go so that the store fits limit."""
        return segments.victims(segments.read_catalogue(self.spark, self.base), limit)

"""Configuration from JSON with defaults (snake_case keys; unknown keys are refused)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.functions.constants import CHECKPOINT_MS, LOG_SIZE, STORE_SIZE
from kvloom.operators.rules import RuleSet


class ConfigError(ValueError):
    pass


@dataclass
class Endpoint:
    addresses: list[str]
    kind: str = "standalone"
    slots: list[tuple[int, int]] = field(default_factory=list)

    def validate(self, what: str) -> None:
        if not self.addresses:
            raise ConfigError(f"{what}: addresses are empty")
        if self.kind == "cluster" and len(self.addresses) < 2:
            raise ConfigError(f"{what}: a cluster needs two addresses or more")


@dataclass
class Replay:
    resume_from_break_point: bool = False
    key_exists: str = "none"
    rdb_parallel: int = 4
    pipeline: bool = False
    transaction: bool = False
    batch_size: int = 64 << 10
    batch_count: int = 100


@dataclass
class Store:
    dir: str = "/tmp/kvloom-store"
    max_size: int = STORE_SIZE
    log_size: int = LOG_SIZE


@dataclass
class Config:
    input: Endpoint
    output: Endpoint
    replay: Replay = field(default_factory=Replay)
    store: Store = field(default_factory=Store)
    rules: RuleSet = field(default_factory=RuleSet)
    checkpoint_ms: int = CHECKPOINT_MS

    def validate(self) -> Config:
        self.input.validate("input")
        self.output.validate("output")
        if self.store.max_size < self.store.log_size:
            raise ConfigError("max_size is below log_size")
        return self


def _make(kind: type, data: dict, where: str):
    known = {f.name for f in fields(kind)}
    if extra := set(data) - known:
        raise ConfigError(f"{where}: unknown {', '.join(sorted(extra))}")
    return kind(**data)


def load(source: str | dict, base_dir: str = ".") -> Config:
    """A Config from a file's path, JSON text or dict; relative store paths are under base_dir."""
    if isinstance(source, str):
        try:
            if os.path.exists(source):
                with open(source, encoding="utf-8") as f:
                    source = f.read()
            source = json.loads(source)
        except ValueError as e:
            raise ConfigError(f"no JSON: {e}") from None
    c = dict(source)
    for name in ("input", "output"):
        if name not in c:
            raise ConfigError(f"{name} is missing")
    try:
        config = Config(
            _make(Endpoint, c["input"], "input"), _make(Endpoint, c["output"], "output"), _make(Replay, c.get("replay", {}), "replay"),
            _make(Store, c.get("store", {}), "store"), RuleSet.from_config(c.get("filter", {})), int(c.get("checkpoint_ms", CHECKPOINT_MS)),
        )
    except TypeError as e:
        raise ConfigError(str(e)) from None
    if not os.path.isabs(config.store.dir):
        config.store.dir = os.path.join(base_dir, config.store.dir)
    return config.validate()


LOADED = "addresses int, output_kind string, rdb_parallel int, batch_size long, dir string, max_size long, log_size long, checkpoint_ms long, rules int, error string"


def load_column(df: DataFrame, text: str, base_dir: str = ".", *keep: str) -> DataFrame:
    """(keep, LOADED): what each configuration of a column of JSON text says with its defaults, or why it is refused."""
    names = [c.split()[0] for c in LOADED.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def one(source: str | None) -> tuple:
        try:
            c = load(json.loads(source or ""), base_dir)
        except ValueError as e:  # ConfigError is one
            return (*[None] * 9, str(e) if isinstance(e, ConfigError) else "no JSON")
        r = c.rules
        rules = sum(map(len, (r.db_black, r.cmd_black, r.prefix_white, r.prefix_black, r.slot_white, r.slot_black)))
        return len(c.input.addresses), c.output.kind, c.replay.rdb_parallel, c.replay.batch_size, c.store.dir, c.store.max_size, c.store.log_size, c.checkpoint_ms, rules, None

    def run(batches):
        for b in batches:
            cols = list(zip(*map(one, b.column(text).to_pylist()), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*keep, *names])

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keep] + [LOADED])
    return df.select(*keep, F.col(text)).mapInArrow(run, schema)

"""Transaction status of command streams, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run_id string, seq long, cmd string, txn string, in_txn boolean"


def next_status(status: str, cmd: str) -> str:
    """No, Begin, In, Commit: status after a command."""
    if cmd == "MULTI":
        return "Begin"
    if cmd == "DISCARD":
        return "No" if status in ("Begin", "In") else status
    if cmd == "EXEC":
        return {"In": "Commit"}.get(status, status)
    return {"Begin": "In", "Commit": "No"}.get(status, status)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status = state.get[0] if state.exists else "No"
    rows = pd.concat(list(frames)).sort_values("seq")
    out, flags = [], []
    for cmd in rows["cmd"]:
        status = next_status(status, cmd)
        out.append(status)
        flags.append(status == "In" and cmd not in ("MULTI", "EXEC", "DISCARD"))
    state.update((status,))
    yield pd.DataFrame({"run_id": key[0], "seq": rows["seq"], "cmd": rows["cmd"], "txn": out, "in_txn": flags})


def track(commands: DataFrame) -> DataFrame:
    """Streaming commands (run_id, seq, cmd) with txn and in_txn; state is one status for each run. Same result as operators.state.transaction_status."""
    return commands.select("run_id", "seq", "cmd").groupBy("run_id").applyInPandasWithState(
        _update, SCHEMA, "status string", "append", GroupStateTimeout.NoTimeout
    )

"""Commands written as log segments: ``df.write.format("respLog")`` and ``df.writeStream.format("respLog")``.

Rows are (run_id, seq, args array<binary>), other columns are not looked at. Each
task writes its commands to files of its own under ``base/.parts``; readers see
none of them. The commit orders the files of a run by seq, gives each the offset
at which the one before ends, and renames them to ``base/{run_id}/{offset}.aof``,
behind what the run has already. Tasks must hold stretches of a run that do not
overlap: ``repartitionByRange("run_id", "seq")`` makes them.

A commit writes down what it will rename before it renames: one that breaks off
is finished, or found finished, when it runs again. A stream's batch is known by
its number, so a batch that runs again adds nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from kvloom.sources.store import required_local


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (run_id, first seq, last seq, size, path)."""

    files: list[tuple]


class _Sink:
    def __init__(self, options, schema, overwrite: bool):
        names = [f.name for f in schema.fields]
        if overwrite:
            raise ValueError("logs are appended to, mode must be append")
        if missing := {"run_id", "seq", "args"} - set(names):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        self.base = required_local(options["path"])
        self.parts = os.path.join(self.base, ".parts")

    def write(self, iterator) -> Written:
        os.makedirs(self.parts, exist_ok=True)
        open_: dict[str, list] = {}
        try:
            for row in iterator:
                run, seq, args = row["run_id"], row["seq"], row["args"]
                if run is None or seq is None or args is None:
                    raise ValueError("run_id, seq and args must not be null")
                own = open_.get(run)
                if own is None:
                    path = os.path.join(self.parts, uuid.uuid4().hex)
                    own = open_[run] = [open(path, "wb"), seq, None, 0, path]
                if own[2] is not None and seq <= own[2]:
                    raise ValueError(f"seq of {run} must ascend: {seq} after {own[2]}")
                data = b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), bytes(a)) for a in args)
                own[0].write(data)
                own[2], own[3] = seq, own[3] + len(data)
            for f, *_ in open_.values():
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            for f, *_, path in open_.values():
                f.close()
                os.unlink(path)
            raise
        for f, *_ in open_.values():
            f.close()
        return Written([(run, a, z, n, path) for run, (_, a, z, n, path) in open_.items()])

    def _end(self, run: str) -> int:
        """Where the run's log ends."""
        from kvloom.sources.resp import _segments

        return max((offset + size for r, offset, _, size in _segments(self.base) if r == run), default=0)

    def _publish(self, messages, name: str) -> None:
        note = os.path.join(self.parts, f"{name}.json")
        if os.path.exists(note):
            # A run of this commit before: what it wrote then counts, what was written now does not.
            self._drop(messages)
        else:
            files = sorted(f for m in messages if m for f in m.files)
            ends: dict[str, tuple] = {}
            moves = []
            for run, first, last, size, path in files:
                at, before = ends.get(run) or (self._end(run), None)
                if before is not None and first <= before:
                    self._drop(messages)
                    raise ValueError(f"tasks overlap in {run}: {first} after {before}")
                moves.append((path, os.path.join(self.base, run, f"{at}.aof")))
                ends[run] = at + size, last
            os.makedirs(self.parts, exist_ok=True)
            with open(note + ".new", "w") as f:
                json.dump(moves, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(note + ".new", note)
        with open(note) as f:
            for path, to in json.load(f):
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if os.path.exists(path):
                    os.replace(path, to)

    @staticmethod
    def _drop(messages) -> None:
        for m in messages:
            for *_, path in m.files if m else []:
                if os.path.exists(path):
                    os.unlink(path)


class LogSink(_Sink, DataSourceWriter):
    def commit(self, messages) -> None:
        self._publish(messages, uuid.uuid4().hex)

    def abort(self, messages) -> None:
        self._drop(messages)


class LogStreamSink(_Sink, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self._publish(messages, f"batch-{batchId}")

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._drop(messages)

"""Alerts as a Spark data source: format ``flowsieve_alerts``, batch and stream, written once per transaction.

Every task writes its alerts as JSON lines into a file of its own and tells the
driver its name (the commit message).  When all tasks are done, one manifest per
transaction names the files; readers read only files that a manifest names.  The
transaction is the stream's batch number, or the option ``transaction`` of a batch
write (a fresh one without it).  A transaction that has a manifest already is not
written again, so a replayed batch adds nothing.  After a failure the files that
were told are deleted; a file of a lost task is never named and never read.

Options: ``path`` (any store that Arrow's file systems reach), ``transaction``.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter,
                                    InputPartition, WriterCommitMessage)

FORMAT = "flowsieve_alerts"
SCHEMA = ("event_id long, src_ip string, dst_ip string, confidence_text string, n_packets int, time_text string, "
          "kind string, attack_type string, status string")


def register(spark: SparkSession) -> str:
    """Make the format known to the session; returns its name."""
    spark.dataSource.register(AlertSource)
    return FORMAT


def _place(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path)


def _named(folder: afs.FileSystem, base: str) -> dict[str, str]:
    """Manifests by transaction."""
    found = folder.get_file_info(afs.FileSelector(f"{base}/_manifests", allow_not_found=True))
    return {f.base_name[:-5]: f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("_")}


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer:
    """What a batch write and a stream write share."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator) -> Written:
        folder, base = _place(self.path)
        first = next(rows, None)
        if first is None:
            return Written(None, 0)
        folder.create_dir(f"{base}/data", recursive=True)
        name, n = f"data/{uuid.uuid4().hex}.jsonl", 0
        with folder.open_output_stream(f"{base}/{name}") as out:
            while first is not None:
                out.write((json.dumps([first[c] for c in self.names]) + "\n").encode())
                n += 1
                first = next(rows, None)
        return Written(name, n)

    def finish(self, messages, transaction: str, replace: bool) -> None:
        folder, base = _place(self.path)
        known = _named(folder, base)
        if transaction in known:
            self.undo(messages)
            return
        folder.create_dir(f"{base}/_manifests", recursive=True)
        told = [m for m in messages if m is not None and m.file]
        hidden = f"{base}/_manifests/_{uuid.uuid4().hex}.json"
        with folder.open_output_stream(hidden) as out:
            out.write(json.dumps({"files": [m.file for m in told], "rows": sum(m.rows for m in told)}).encode())
        folder.move(hidden, f"{base}/_manifests/{transaction}.json")
        if replace:
            for old in known.values():
                folder.delete_file(old)

    def undo(self, messages) -> None:
        folder, base = _place(self.path)
        for m in messages:
            if m is not None and m.file:
                folder.delete_file(f"{base}/{m.file}")


class AlertWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], transaction: str, replace: bool):
        self.own, self.transaction, self.replace = _Writer(path, names), transaction, replace

    def write(self, iterator):
        return self.own.write(iterator)

    def commit(self, messages):
        self.own.finish(messages, self.transaction, self.replace)

    def abort(self, messages):
        self.own.undo(messages)


class AlertStreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, names: list[str]):
        self.own = _Writer(path, names)

    def write(self, iterator):
        return self.own.write(iterator)

    def commit(self, messages, batchId):
        self.own.finish(messages, f"batch-{batchId}", False)

    def abort(self, messages, batchId):
        self.own.undo(messages)


class AlertReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        folder, base = _place(self.path)
        files = []
        for manifest in sorted(_named(folder, base).values()):
            with folder.open_input_stream(manifest) as f:
                files += json.loads(f.read())["files"]
        return [InputPartition(x) for x in files] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        folder, base = _place(self.path)
        with folder.open_input_stream(f"{base}/{partition.value}") as f:
            for line in io.TextIOWrapper(f, "ascii"):
                yield tuple(json.loads(line))


class AlertSource(DataSource):
    """The format; ``path`` is required."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return AlertReader(self.options["path"])

    def writer(self, schema, overwrite):
        return AlertWriter(self.options["path"], schema.names, self.options.get("transaction", uuid.uuid4().hex), overwrite)

    def streamWriter(self, schema, overwrite):
        return AlertStreamWriter(self.options["path"], schema.names)

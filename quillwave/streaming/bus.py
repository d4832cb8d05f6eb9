"""The action bus: actions are delivered once, whatever is repeated, killed or recognised twice.

`once` is a stateful step: it remembers the ids of each device's actions for a while of event time and lets each through
once; of what one batch brings a device, the first `CAPACITY` go on and the rest are dropped, as a full bus drops what
is published to it.  `action_bus` is a streaming sink with a commit: tasks write files that nobody reads, and an epoch
counts from the moment its manifest is there.  An epoch that comes again finds its manifest and changes nothing; files of
an epoch that was killed are in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Actions of a device that a batch delivers at most.
CAPACITY = 16
REMEMBERED_MS = 60_000
ACTION = "device_id long, query_id string, at long, command_id string, action string"
_KIND = pa.schema([("device_id", pa.int64()), ("query_id", pa.string()), ("at", pa.int64()), ("command_id", pa.string()), ("action", pa.string())])


def first_of_each(seen: dict[str, int], rows: list[tuple[int, str]], remembered: int, capacity: int) -> tuple[list[int], dict[str, int]]:
    """Which of `rows` (time, id) go on, and what is remembered then.  Rows older than what is remembered are dropped.

    An id counts as seen when it was let through or dropped for want of room: what was dropped does not come later.
    """
    newest, out, seen = max([*seen.values(), *(at for at, _ in rows)], default=0), [], dict(seen)
    before = max(seen.values(), default=None)
    for i in sorted(range(len(rows)), key=lambda i: rows[i]):
        at, query = rows[i]
        if query in seen or before is not None and at < before - remembered:
            continue
        seen[query] = at
        if len(out) < capacity:
            out.append(i)
    return out, {q: at for q, at in seen.items() if at >= newest - remembered}


class Once(StatefulProcessor):
    """The ids of a device's recent actions."""

    def __init__(self, remembered: int, capacity: int):
        self.remembered, self.capacity = remembered, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "query_id string", "at long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows), ignore_index=True)
        before = {k[0]: v[0] for k, v in self.seen.iterator()}
        kept, after = first_of_each(before, list(zip(pdf["at"].tolist(), pdf["query_id"].tolist(), strict=True)), self.remembered, self.capacity)
        for query in before.keys() - after.keys():
            self.seen.removeKey((query,))
        for query in after.keys() - before.keys():
            self.seen.updateValue((query,), (int(after[query]),))
        yield pdf.iloc[kept][[f.name for f in _KIND]]

    def close(self) -> None:
        pass


def once(actions: DataFrame, remembered_ms: int = REMEMBERED_MS, capacity: int = CAPACITY) -> DataFrame:
    """A stream of ACTION rows, each id once while it is remembered; needs the RocksDB state store."""
    rows = actions.selectExpr("device_id", "CAST(query_id AS STRING) AS query_id", "at", "command_id", "action")
    return rows.groupBy("device_id").transformWithStateInPandas(Once(remembered_ms, capacity), outputStructType=ACTION, outputMode="Append", timeMode="None")


class Files(WriterCommitMessage):
    def __init__(self, names: list[str], rows: int):
        self.names, self.rows = names, rows


class ActionBusWriter(DataSourceStreamArrowWriter):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        name, out, rows = f"actions-{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = pq.ParquetWriter(f"{root}/{name}", _KIND, filesystem=fs)
                out.write_table(pa.Table.from_batches([batch]).select(_KIND.names).cast(_KIND))
                rows += batch.num_rows
        if out is not None:
            out.close()
        return Files([name] if rows else [], rows)

    def _manifest(self, root: str, epoch: int) -> str:
        return f"{root}/epochs/{epoch:012d}.json"

    def commit(self, messages: list[Files | None], batchId: int) -> None:  # noqa: N803
        """The epoch's manifest, written whole and then renamed; one that is there already stands."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        target = self._manifest(root, batchId)
        names = [n for m in messages if m is not None for n in m.names]
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            self._remove(fs, root, names)
            return
        fs.create_dir(f"{root}/epochs", recursive=True)
        waiting = f"{root}/epochs/.{uuid.uuid4().hex}"
        with fs.open_output_stream(waiting) as f:
            f.write(json.dumps({"files": names}).encode())
        fs.move(waiting, target)

    def abort(self, messages: list[Files | None], batchId: int) -> None:  # noqa: N803
        fs, root = pafs.FileSystem.from_uri(self.folder)
        self._remove(fs, root, [n for m in messages if m is not None for n in m.names])

    def _remove(self, fs: pafs.FileSystem, root: str, names: list[str]) -> None:
        for name in names:
            if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/{name}")


class ActionBus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "action_bus"

    def schema(self) -> str:
        return ACTION

    def streamWriter(self, schema: StructType, overwrite: bool) -> ActionBusWriter:  # noqa: N802
        return ActionBusWriter(self.options)


def publish_stream(actions: DataFrame, path: str, checkpoint: str):
    """A writer to start: actions of a stream, each delivered once to the bus under `path`."""
    actions.sparkSession.dataSource.register(ActionBus)
    return once(actions).writeStream.format("action_bus").option("path", path).option("checkpointLocation", checkpoint)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """The actions of committed epochs."""
    fs, root = pafs.FileSystem.from_uri(path.rstrip("/"))
    names: list[str] = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/epochs", allow_not_found=True)), key=lambda i: i.base_name):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path) as f:
                names += json.loads(f.read())["files"]
    return spark.read.schema(ACTION).parquet(*[f"{path.rstrip('/')}/{n}" for n in names]) if names else spark.createDataFrame([], ACTION)

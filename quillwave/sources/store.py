"""Commands and templates as Parquet tables, with the store's update rules as rewrites."""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.config import CONDITIONS

COMMAND_SCHEMA = "command_id string, label string, action string"
TEMPLATE_SCHEMA = "template_id string, command_id string, condition string, created_at long, features array<array<float>>"
_HEAD = struct.Struct("<ii")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of their key; other tables are not touched, so a command keeps its templates."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_command(commands: DataFrame, templates: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands and their templates go."""
    return commands.join(ids, "command_id", "left_anti"), templates.join(ids, "command_id", "left_anti")


def delete_templates(templates: DataFrame, ids: DataFrame) -> DataFrame:
    return templates.join(ids, "template_id", "left_anti")


def known_condition(column: str = "condition") -> Column:
    """An unknown stored condition reads as OTHER."""
    return F.when(F.col(column).isin(*CONDITIONS), F.col(column)).otherwise(F.lit("OTHER"))


def template_counts(commands: DataFrame, templates: DataFrame) -> DataFrame:
    """Each command with its number of templates, zero included."""
    counts = templates.groupBy("command_id").agg(F.count("*").alias("templates"))
    return commands.join(counts, "command_id", "left").withColumn("templates", F.coalesce("templates", F.lit(0).cast("long")))


def header(frames: int, width: int) -> bytes:
    return _HEAD.pack(frames, width)


def encode_features(features) -> bytes:
    """Little-endian frames, width, then the values; nothing is zero frames of width zero."""
    frames = np.asarray(features, dtype="<f4") if features is not None and len(features) else np.zeros((0, 0), "<f4")
    return _HEAD.pack(*frames.shape) + frames.tobytes()


def decode_features(raw: bytes | None) -> list[list[float]]:
    """The frames; of fewer than 8 bytes none, and of a cut body a ValueError."""
    if raw is None or len(raw) < _HEAD.size:
        return []
    frames, width = _HEAD.unpack_from(raw)
    return np.frombuffer(raw, "<f4", frames * width, _HEAD.size).reshape(frames, width).tolist()


def with_encoded(rows: DataFrame) -> DataFrame:
    """`rows` with `raw` in place of `features`; whole Arrow batches are encoded, row by row only their slices."""
    keep = [c for c in rows.columns if c != "features"]

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            frames, at, out = lists.flatten(), 0, []
            first, n_frames, sizes = 0, lists.value_lengths().fill_null(0).to_pylist(), frames.value_lengths().to_pylist()
            for n in n_frames:
                width = sizes[first] if n else 0
                out.append(header(n, width) + flat[at : at + 4 * n * width])
                first, at = first + n, at + 4 * n * width
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=[*keep, "raw"])

    return rows.select("features", *keep).mapInArrow(run, _schema(rows, keep, "raw binary"))


def with_decoded(rows: DataFrame) -> DataFrame:
    """`rows` with `features` in place of `raw`."""
    keep = [c for c in rows.columns if c != "raw"]

    def run(batches):
        kind = pa.list_(pa.list_(pa.float32()))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([decode_features(r) for r in batch.column(0).to_pylist()], kind)], names=[*keep, "features"])

    return rows.select("raw", *keep).mapInArrow(run, _schema(rows, keep, "features array<array<float>>"))


def _schema(rows: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [more])


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


#: Keys named in a version file itself; more of them go to a file of their own.
INLINE = 256
BUCKETS, COMPACT_AT = 16, 64
_TABLES = {"commands": (COMMAND_SCHEMA, "command_id"), "templates": (TEMPLATE_SCHEMA, "template_id")}
_PART = r".*/(?:commands|templates)-([0-9a-f]{32})/"


class TemplateStore:
    """Commands and templates under one folder, as parts that are never changed.

    A change writes a part of its own: the rows that it puts, or the keys that it takes away, and then a version file that
    lists all parts of both tables, under a number that only one writer can get.  A writer that comes second adds its part
    to the other's list, so no change is lost, nothing is written twice, and readers see a whole change or none of it.
    A part's place in the list tells its age: a row counts unless its key, or for a template its command, is named by a later
    part.  Old versions can be read as long as `vacuum` has not removed their parts.

    Rows lie in buckets by a hash of their command, and a version file lists the files of each bucket.  So the
    templates of one command are read from that bucket's files alone.  Up to `INLINE` keys of a part are in the version file too.
    After `COMPACT_AT` parts a change writes a table whole again.
    """

    TRIES = 20

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.versions = f"{self.folder}/versions"
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.versions).getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.versions).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # Versions

    def latest(self) -> tuple[int, dict]:
        """The last version's number and what it lists; 0 and nothing before the first change."""
        folder = self._path(self.versions)
        numbers = [int(f.getPath().getName()[1:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("v")] if self._fs.exists(folder) else []
        return (max(numbers), self.version(max(numbers))) if numbers else (0, self.version(0))

    def version(self, n: int) -> dict:
        """What a version lists: the number of buckets, and the parts of each table, oldest first."""
        if not n:
            return {"buckets": self.buckets, "commands": [], "templates": []}
        stream = self._fs.open(self._path(f"{self.versions}/v{n:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, n: int, state: dict) -> bool:
        waiting, target = self._path(f"{self.folder}/waiting-{uuid.uuid4().hex}"), self._path(f"{self.versions}/v{n:012d}.json")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(waiting, False)
        out.write(json.dumps(state).encode())
        out.close()
        try:
            self._files.rename(waiting, target, self._no_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(waiting, False)
            return False
        return True

    def _committed(self, make: Callable[[int, dict], dict]) -> int:
        """Commit what `make` turns the newest version into, again and again until no other writer was first."""
        for _ in range(self.TRIES):
            n, state = self.latest()
            if self._commit(n + 1, make(n, state)):
                return n + 1
        raise Conflict(self.folder)

    # Parts

    def _written(self, name: str, rows: DataFrame, kind: str, key: str) -> dict:
        """A new part of `rows`; kinds are base, put and gone.  What only names keys isn't dealt to buckets."""
        part = {"id": uuid.uuid4().hex, "kind": kind, "key": key, "files": {}, "keys": None}
        folder = f"{self.folder}/{name}-{part['id']}"
        if kind == "gone":
            keys = [r[0] for r in rows.select(key).distinct().limit(INLINE + 1).collect()]
            if len(keys) <= INLINE:
                return part | {"keys": keys}
            rows.select(key).distinct().write.parquet(folder)
        else:
            if kind == "put":
                rows = rows.dropDuplicates([key])
            bucket = F.pmod(F.xxhash64("command_id"), F.lit(self.latest()[1]["buckets"])).cast("int")
            rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        root = self._path(folder)
        each = self._fs.listFiles(root, True)
        while each.hasNext():
            path = each.next().getPath()
            if path.getName().startswith("part-"):
                inner = path.getParent().getName()
                part["files"].setdefault(inner[7:] if inner.startswith("bucket=") else "", []).append(f"{inner}/{path.getName()}" if inner.startswith("bucket=") else path.getName())
        if kind == "put" and part["files"]:
            keys = [r[0] for r in self.spark.read.parquet(folder).select(key).limit(INLINE + 1).collect()]
            part["keys"] = keys if len(keys) <= INLINE else None
        return part

    def _paths(self, name: str, parts: list[dict], bucket: int | None = None) -> list[str]:
        return [f"{self.folder}/{name}-{p['id']}/{f}" for p in parts for b, files in p["files"].items() if bucket is None or b in ("", str(bucket)) for f in files]

    def _age(self, parts: list[dict], path: Column) -> Column:
        """The place of a row's part in the list, by the name of its file."""
        places = F.create_map(*[F.lit(x) for i, p in enumerate(parts) for x in (p["id"], i)])
        return F.element_at(places, F.regexp_extract(path, _PART, 1))

    def _later(self, name: str, parts: list[dict], key: str) -> DataFrame | None:
        """(key, later): the newest part that names each key, of the parts after the first one with rows."""
        first = next((i for i, p in enumerate(parts) if p["kind"] != "gone"), len(parts))
        inline = [(k, i) for i, p in enumerate(parts) if i > first and p["key"] == key and p["keys"] is not None for k in p["keys"]]
        filed = [p for p in parts[first + 1 :] if p["key"] == key and p["keys"] is None and p["files"]]
        found = self.spark.createDataFrame(inline, f"{key} string, later int") if inline else None
        if filed:
            rows = self.spark.read.schema(f"{key} string").parquet(*self._paths(name, filed)).select(key, self._age(parts, F.col("_metadata.file_path")).alias("later"))
            found = rows if found is None else found.union(rows)
        return None if found is None else found.groupBy(key).agg(F.max("later").alias("later"))

    def _rows(self, state: dict, name: str, bucket: int | None = None) -> DataFrame:
        schema, key = _TABLES[name]
        parts = state[name]
        paths = self._paths(name, [p for p in parts if p["kind"] != "gone"], bucket)
        if not paths:
            return self.spark.createDataFrame([], schema)
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = self.spark.read.schema(schema).parquet(*paths)
        killers = [(k, later) for k in {key, "command_id"} if (later := self._later(name, parts, k)) is not None]
        if killers:
            rows = rows.select(*columns, self._age(parts, F.col("_metadata.file_path")).alias("_age"))
        for k, later in killers:
            rows = rows.join(later, k, "left").where(F.col("later").isNull() | (F.col("later") <= F.col("_age"))).drop("later")
        return rows.select(*columns)

    def _add(self, *parts: tuple[str, dict]) -> int:
        def with_parts(n: int, state: dict) -> dict:
            return state | {name: state[name] + [p for t, p in parts if t == name and (p["files"] or p["keys"])] for name in _TABLES}

        n = self._committed(with_parts)
        state = self.version(n)
        if any(len(state[name]) > COMPACT_AT for name in _TABLES):
            n = self.compact()
        return n

    def compact(self) -> int:
        """Each table as one part; what other writers add meanwhile stays after it."""
        n, state = self.latest()
        whole = {name: self._written(name, self._rows(state, name), "base", key) for name, (_, key) in _TABLES.items()}
        old = {p["id"] for name in _TABLES for p in state[name]}
        return self._committed(lambda _, now: now | {name: [whole[name]] + [p for p in now[name] if p["id"] not in old] for name in _TABLES})

    def vacuum(self, keep: int = 1) -> int:
        """Remove the parts that none of the last `keep` versions lists, and those versions; gives the number of parts."""
        n, _ = self.latest()
        used = {p["id"] for k in range(max(1, n - keep + 1), n + 1) for name in _TABLES for p in self.version(k)[name]}
        gone = [f.getPath() for f in self._fs.listStatus(self._path(self.folder)) if (found := re.fullmatch(r"(?:commands|templates)-([0-9a-f]{32})", f.getPath().getName())) and found[1] not in used]
        for k in range(1, n - keep + 1):
            self._fs.delete(self._path(f"{self.versions}/v{k:012d}.json"), False)
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    # Reading

    def commands(self, version: int | None = None) -> DataFrame:
        return self._rows(self.latest()[1] if version is None else self.version(version), "commands")

    def templates(self, version: int | None = None) -> DataFrame:
        return self._rows(self.latest()[1] if version is None else self.version(version), "templates")

    def templates_for(self, command_id: str) -> DataFrame:
        """The templates of one command, from its bucket's files alone."""
        _, state = self.latest()
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(command_id)), F.lit(state["buckets"]))).first()[0]
        return self._rows(state, "templates", bucket).where(F.col("command_id") == command_id)

    def changes(self, name: str, after: int, upto: int) -> tuple[DataFrame, DataFrame]:
        """(rows put, keys gone) of a table by the versions after one and up to another; a key gone is (key, value).

        Of a table that was compacted in between, the parts that the compaction took in are not told apart any more: then
        its rows are all told as put.
        """
        schema, key = _TABLES[name]
        known = {p["id"] for p in self.version(after)[name]}
        state = self.version(upto)
        new = [p for p in state[name] if p["id"] not in known]
        puts = self._rows(state | {name: new}, name)
        gone = self.spark.createDataFrame([(p["key"], k) for p in new if p["kind"] == "gone" and p["keys"] for k in p["keys"]], "key string, value string")
        for p in new:
            if p["kind"] == "gone" and p["files"]:
                gone = gone.union(self.spark.read.parquet(*self._paths(name, [p])).select(F.lit(p["key"]), p["key"]))
        return puts, gone

    # Changing

    def change(self, apply: Callable[[DataFrame, DataFrame], dict[str, DataFrame]]) -> int:
        """Commit what `apply(commands, templates)` makes of the tables that it names, whole; returns the version's number."""
        for _ in range(self.TRIES):
            n, state = self.latest()
            made = apply(self._rows(state, "commands"), self._rows(state, "templates"))
            new = state | {name: [self._written(name, df, "base", _TABLES[name][1])] for name, df in made.items()}
            if self._commit(n + 1, new):
                return n + 1
        raise Conflict(self.folder)

    def upsert_commands(self, rows: DataFrame) -> int:
        return self._add(("commands", self._written("commands", rows, "put", "command_id")))

    def add_templates(self, rows: DataFrame) -> int:
        return self._add(("templates", self._written("templates", rows, "put", "template_id")))

    def delete_commands(self, ids: DataFrame) -> int:
        """Commands and their templates go, in one change."""
        return self._add(*((name, self._written(name, ids, "gone", "command_id")) for name in _TABLES))

    def delete_templates(self, ids: DataFrame) -> int:
        return self._add(("templates", self._written("templates", ids, "gone", "template_id")))

    # Following

    def _followed(self, then: Callable[[int], None], checkpoint: str):
        seen = self.spark.readStream.format("text").load(self.versions).select(F.regexp_extract(F.col("_metadata.file_name"), r"v([0-9]+)", 1).cast("long").alias("n"))

        def each(batch: DataFrame, epoch: int) -> None:
            newest = batch.agg(F.max("n")).first()[0]
            if newest is not None:
                then(newest, epoch)

        return seen.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)

    def live(self, then: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
        """A running stream that calls `then(commands, templates, epoch)` for the store as it is, and again after changes."""
        return self._followed(lambda _, epoch: then(self.commands(), self.templates(), epoch), checkpoint)

    def live_changes(self, then: Callable[[str, DataFrame, DataFrame, int], None], checkpoint: str, after: int = 0):
        """A running stream that calls `then(table, puts, gone, version)` with what changed since the call before.

        The version told last is written beside the checkpoint after its calls, so after a crash in between they are repeated.
        """
        mark = self._path(f"{checkpoint.rstrip('/')}-told")

        def told(newest: int, _: int) -> None:
            start = after
            if self._fs.exists(mark):
                stream = self._fs.open(mark)
                start = int(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
            for name in _TABLES:
                puts, gone = self.changes(name, start, newest)
                then(name, puts, gone, newest)
            out = self._fs.create(mark, True)
            out.write(str(newest).encode())
            out.close()

        return self._followed(told, checkpoint)

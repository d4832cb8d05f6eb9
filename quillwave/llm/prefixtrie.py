"""Prefix trie of conversations: sorted turn arrays, adjacent common prefixes, a stack sweep into nodes.

1. Each turn becomes a 16-byte fingerprint of role and text, and each conversation one row: the fingerprints of its
   turns in order as one binary key, and the sizes of its texts.
2. Spark sorts the rows by range of (key, conv_id), so copies of one conversation are spread over tasks like any others.
   Equal prefixes are neighbours now.
3. A sweep over each range keeps the nodes on the path of the last conversation on a stack.  The length of the prefix
   shared with the next one (LCP) says which nodes end there; they add their members, leaves and savings to their parent
   and go out.  Nodes that may go on in the neighbouring ranges, those on the path of a range's first or last
   conversation, stay open: their parts go out as two paths a range.
4. One small task stitches the paths in the order of the ranges with the same kind of stack.  It reads two paths a
   range, and holds one.
5. A node's parent is known by its smallest member only when it ends.  Where that is later than the child, the child
   asks for it by the hash of the parent's prefix and a part number; a parent answers as many parts as were asked, so
   no key holds more than `ANSWERS` children of a range.

A SHA-256 is made from start to end, so the ids that end at one open node are hashed by one task in a stream; they come
in rows of `IDS_A_ROW`, none is held.  A conversation is one row of 20 bytes a turn.

Null roles and texts are empty.  Turns are ordered by number, null first, and those of one number by their fingerprint,
so repeated rows and ties have a defined order.  Rows with a null conv_id belong to no conversation and are left out.
An empty table has no nodes, not even a root.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import stash, tidy

FAMILY, HEADS = 5, 9
KEY = 16
ANSWERS = 64
IDS_A_ROW = 4096
OUT_ROWS = 8192

ROOT = bytes(KEY)
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "node binary, parent binary, part int, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, asked int"
SWEPT = f"{NODE}, stretch int, seq long, ids string, first_key binary, last_key binary, open_depth int, first_path array<array<long>>, last_path array<array<long>>"
_NAMES = [c.split()[0] for c in SWEPT.split(", ")]
_PATH = pa.list_(pa.list_(pa.int64()))
_KINDS = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), _PATH, _PATH]
_AT = {name: i for i, name in enumerate(_NAMES)}


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns: array of (fingerprint, size), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    fingerprint = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"), fingerprint.alias("fingerprint"), F.octet_length(text).cast("long").alias("size"))
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda t: F.struct(t["fingerprint"].alias("fingerprint"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation c starts with the first h turns of c - c % 5 in place of its own first h."""
    own = turn_arrays(conversations)
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("of"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def sorted_keys(conversations: DataFrame) -> DataFrame:
    """(key, sizes, conv_id), globally sorted by range; `conversations`: (conv_id, turns)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["fingerprint"])), ""))
    rows = stash(conversations.select(key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "conv_id"), "turn-keys")
    return rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // KEY
    lo, hi = 0, least // KEY  # a[:lo] is shared, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * KEY] == b[: mid * KEY] else (lo, mid)
    return lo


class Node:
    """What is known so far of a node on the stack: its own ends and the children that ended."""

    __slots__ = ("asked", "convs", "ids", "kids", "leaves", "least", "name", "part", "saved", "size")

    def __init__(self, name: bytes, size: int, part: int = 0, values: tuple = (0, None, 0, 0, 0, 0)):
        self.name, self.size, self.part, self.ids = name, size, part, []
        self.convs, self.least, self.kids, self.leaves, self.saved, self.asked = values

    def values(self) -> list[int | None]:
        return [self.convs, self.least, self.kids, self.leaves, self.saved, self.asked, self.size]

    def member(self, conv: int) -> None:
        self.convs += 1
        self.least = conv if self.least is None else min(self.least, conv)
        self.ids.append(conv)

    def gather(self, convs: int, least: int | None, kids: int, leaves: int, saved: int, asked: int) -> None:
        self.convs += convs
        self.kids += kids
        self.leaves += leaves
        self.saved += saved
        self.asked = max(self.asked, asked)
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)


def child_name(parent: bytes, fingerprint: bytes) -> bytes:
    return hashlib.md5(parent + fingerprint).digest()


class Rows:
    """Rows of SWEPT, given out in batches."""

    def __init__(self):
        self.rows: list[list] = []

    def add(self, **values) -> None:
        row = [None] * len(_NAMES)
        for name, value in values.items():
            row[_AT[name]] = value
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True) if rows else [()] * len(_NAMES), _KINDS, strict=True)], names=_NAMES)


def end(stack: list[Node], parent_ends: bool, out: Rows, ends: str | None) -> None:
    """Take the deepest node off the stack: it goes out, and its parent gathers it.

    If the parent ends right after, it has no later members, so its smallest one is known here.
    """
    node, depth = stack.pop(), len(stack)
    node.leaves += node.kids == 0
    node.saved += (node.convs - 1) * node.size
    known = asks = None
    if stack:
        up = stack[-1]
        up.gather(node.convs, node.least, 0, node.leaves, node.saved, 0 if parent_ends else node.part + 1)
        known, asks = (up.least, None) if parent_ends else (None, up.name)
    out.add(node=node.name, parent=asks, part=node.part, parent_conv_id=known, conv_id=node.least, depth=depth, n_convs=node.convs, n_children=node.kids, n_leaves=node.leaves, saved_tokens=node.saved, ends_sha256=ends, asked=node.asked)


def ends_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NO_ENDS


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that lie wholly in this stretch; ids that end at open nodes; the two open paths."""
    stretch, out = TaskContext.get().partitionId(), Rows()
    stack: list[Node] = []
    first_path: list[list] = []  # of nodes of the first path that ended, deepest last
    first = last = None
    opened = 0  # nodes up to this depth are still those of the first path

    def loose(node: Node) -> None:
        for seq, at in enumerate(range(0, len(node.ids), IDS_A_ROW)):
            out.add(node=node.name, stretch=stretch, seq=seq, ids=",".join(map(str, node.ids[at : at + IDS_A_ROW])))

    for batch in batches:
        for key, sizes, conv in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            deep = len(sizes)
            if first is None:
                first, opened, shared = key, deep, 0
                stack.append(Node(ROOT, 0))
            else:
                shared = common_turns(last, key)
                while len(stack) - 1 > shared:
                    depth = len(stack) - 1
                    if depth <= opened:
                        loose(stack[-1])
                        first_path.append(stack.pop().values())
                    else:
                        end(stack, depth - 1 > max(shared, opened), out, ends_of(stack[-1].ids))
                opened = min(opened, shared)
            for depth in range(shared, deep):
                up, part = stack[-1], 0
                if first is not key:  # what the first path starts is counted when ranges are stitched
                    part = up.kids // ANSWERS
                    up.kids += 1
                stack.append(Node(child_name(up.name, key[depth * KEY : (depth + 1) * KEY]), sizes[depth], part))
            stack[-1].member(conv)
            last = key
            if len(out.rows) >= OUT_ROWS:
                yield out.batch()
    if first is not None:
        for node in stack:
            loose(node)
        through = [node.values() for node in stack[: opened + 1]]
        out.add(stretch=stretch, first_key=first, last_key=last, open_depth=opened, first_path=through + first_path[::-1], last_path=[node.values() for node in stack[opened + 1 :]])
    yield out.batch()


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that were open at the ends of stretches, from their paths in the order of the stretches."""
    stack: list[Node] = []
    out, last = Rows(), b""

    def push(key: bytes, values: list) -> None:
        depth = len(stack)
        name = child_name(stack[-1].name, key[(depth - 1) * KEY : depth * KEY]) if depth else ROOT
        stack.append(Node(name, values[-1], 0, tuple(values[:-1])))

    def close(down_to: int) -> None:
        while len(stack) - 1 > down_to:
            end(stack, len(stack) - 2 > down_to, out, None)

    for batch in batches:
        for first, final, opened, left, right in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("first_key", "last_key", "open_depth", "first_path", "last_path")), strict=True):
            shared = common_turns(last, first) if stack else -1
            close(shared)
            for depth, values in enumerate(left):
                if depth <= shared:
                    stack[depth].gather(*values[:-1])
                else:
                    if depth:
                        stack[-1].kids += 1
                    push(first, values)
            close(opened)
            for values in right:
                push(final, values)
            last = final
            if len(out.rows) >= OUT_ROWS:
                yield out.batch()
    close(-1)
    yield out.batch()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids) in order: one SHA-256 of each node's ids, comma-joined, in a stream."""
    node, state, names, ends = None, None, [], []
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    names.append(node)
                    ends.append(state.hexdigest())
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        names.append(node)
        ends.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ends, pa.string())], names=["of", "ends"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of `conversations`: (conv_id, turns)."""
    swept = stash(sorted_keys(conversations).mapInArrow(tidy(sweep), SWEPT), "trie-sweep")
    paths = swept.where("open_depth IS NOT NULL").repartition(1).sortWithinPartitions("stretch")
    loose = swept.where("ids IS NOT NULL").select("node", "stretch", "seq", "ids").repartition("node").sortWithinPartitions("node", "stretch", "seq")
    hashed = loose.select("node", "ids").mapInArrow(_hash_ids, "of binary, ends string")
    columns = [c.split()[0] for c in NODE.split(", ")]
    open_nodes = paths.mapInArrow(stitch, SWEPT).select(*columns).join(hashed, F.col("node") == F.col("of"), "left")
    open_nodes = stash(open_nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).select(*columns), "trie-stitched")
    nodes = swept.where("depth IS NOT NULL").select(*columns).unionByName(open_nodes)
    answers = nodes.where("asked > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("answer"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("part"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    asking = nodes.where("parent IS NOT NULL").join(answers, ["parent", "part"], "left").withColumn("parent_conv_id", F.col("answer"))
    return nodes.where("parent IS NULL").select(*result).unionByName(asking.select(*result))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its family."""
    return trie(rebuilt(conversations))


#: CRC-32 of a string in SQL: the polynomial is a fixed value; the table is made of it.
_CRC = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries)"""

ORACLE = f"""
WITH {_CRC},
own AS (
  SELECT conv_id, list({{'k': md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 'size': octet_length(encode(coalesce(text, '')))}}
         ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
         lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (
  SELECT conv_id, turns, d, array_to_string(list_transform(turns[1:d], lambda t: t.k), '') AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(turns[d].size), 0) AS size,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths GROUP BY path, d),
kids AS (SELECT path[1:32 * (depth - 1)] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
above AS (SELECT path[1:32 * e] AS up, n_children = 0 AS leaf, (n_convs - 1) * size AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM full_nodes)),
sums AS (SELECT up, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY up)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.up = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:32 * (n.depth - 1)]
"""

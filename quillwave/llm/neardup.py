"""MinHash near-duplicates through an LSH forest, confirmed on full shingle sets.

1. Each text gives its set of word shingles (64-bit hashes), a hash of that set, and a signature of `POSITIONS`
   one-byte minima.  Texts with equal sets form one class; the smallest id stands for it.
2. Forest: each of `TREES` trees orders all classes by the signature read from another position on.  Spark sorts
   the (tree, rotated signature) rows by range, so a dense region is spread over tasks like any other.  In a scan
   of the order every class meets its `WINDOW` predecessors that share a prefix of at least `MIN_DEPTH` values:
   in a region of up to `WINDOW` classes that is every pair, in a denser one it is those with the longest common
   prefixes, so the depth follows the region.  Pairs whose signatures agree too little are dropped (the bound lies
   five standard deviations under the threshold).  A class is linked with the first class of its run only.  The
   ends of the ranges are scanned once more together, so candidates don't depend on where ranges end.
3. Connected candidates form groups.  Groups of up to `CELL` classes (and `CELL_SHINGLES` shingles) are confirmed
   whole in one task by exact intersections of full sets.  Larger groups are cut into cells of about that size, each
   with a few classes that all cells share.  That links what is alike throughout.  Classes outside their group's
   main component afterwards are compared with all others of the group: stripe by cell if they fill no more than
   `GRID_STRIPES` cells, else by a prefix-filtered join, since a link at the threshold shares one of either side's
   rarest shingles; only classes with one there that more than `POSTINGS` have go stripe by cell then.
   So no link between classes of a group is lost, whatever its size, and no task holds more than two cells.
4. Components of the confirmed links.

Nothing is capped: the window limits only which candidates connect a group.  Null, empty and wordless texts have
no shingles and link with nothing.  A text of fewer words than a shingle is one shingle.  Rows with a null id link
with nothing and are kept.  Rows that share an id and have different texts are judged each by its text, and the id
stands for both.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.bitmaps import likely
from quillwave.llm.common import BROADCAST_IDS, TEXT_KEY, stash, text_key, tidy, without
from quillwave.llm.components import components, star_groups

SHINGLE_WORDS = 4
THRESHOLD = (80, 100)
POSITIONS = 96
TREES, STRIDE, MIN_DEPTH = 19, 5, 4
WINDOW = 24
MIN_MATCHES = 57
CELL = 192
CELL_SHINGLES = 1 << 21
GRID_STRIPES = 8
POSTINGS = 1024
SHARED = 8

_SEEDS = tk.mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:POSITIONS, None], _SEEDS[POSITIONS:, None] | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = tk.text_bytes(column)
    low = tk.lower(data)
    starts, ends, rows = tk.word_bounds(low, offsets, tk.NON_SPACE)
    words = tk.span_hashes(low, starts, ends)
    hashes, first = tk.shingle_hashes(words, rows, k)
    n = len(offsets) - 1
    cut = np.searchsorted(rows[first], np.arange(n + 1))
    word_cut = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        own = hashes[cut[i] : cut[i + 1]]
        if not len(own) and word_cut[i + 1] > word_cut[i]:
            own = np.array([tk.whole_hash(words[word_cut[i] : word_cut[i + 1]])], dtype=np.uint64)
        own = np.sort(own)
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out


def signature(own: np.ndarray) -> bytes:
    """One byte for each position: the low byte of the mixed minimum."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 2048):
        np.minimum(least, ((own[None, at : at + 2048] ^ _XOR) * _MUL).min(axis=1), out=least)
    return (tk.mix(least) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _describe(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi in tk.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column(1), k)
                with np.errstate(over="ignore"):
                    h1 = np.array([s.sum() for s in sets], dtype=np.uint64)
                    h2 = np.array([tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), part.column(2),
                ], names=["doc_id", "n_shingles", "h1", "h2", "sig", TEXT_KEY])

    return run


def _local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable for each of n points."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for ends in (a, b):
            np.minimum.at(label, label[ends], least)
            np.minimum.at(label, ends, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _forest_scan(borders: bool):
    """Links of one stretch of the sorted orders: each class with the hub of the run of candidates that it lies in.

    Rows of a stretch's own first and last `WINDOW` classes go out as well, under the stretch's number; a second scan of
    those alone, with `borders`, compares across the ends of stretches what the first one could not see.
    """

    def run(batches):
        stretch = TaskContext.get().partitionId()
        empty = np.zeros(0, np.int64)
        key, sig, node, part, hub = np.zeros(0, np.uint64), np.zeros((0, POSITIONS), np.uint8), empty, empty, empty
        seen, last = 0, None
        for batch in batches:
            old, n = len(node), batch.num_rows
            fresh = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, POSITIONS)
            tree = batch.column(0).to_numpy().astype(np.uint64)
            prefix = np.ascontiguousarray(fresh[:, :MIN_DEPTH]).view(np.uint32).ravel().astype(np.uint64)
            key, sig, node = np.concatenate([key, prefix | tree << np.uint64(32)]), np.concatenate([sig, fresh]), np.concatenate([node, batch.column(2).to_numpy()])
            part = np.concatenate([part, batch.column(3).to_numpy() if borders else np.full(n, stretch)])
            hub = np.concatenate([hub, node[old:]])
            a, b = [empty], [empty]
            for step in range(1, WINDOW + 1):
                at = np.flatnonzero(key[step:] == key[:-step])
                if not len(at):
                    break
                at = at[at + step >= old]
                if borders:
                    at = at[part[at] != part[at + step]]
                at = at[(sig[at + step] == sig[at]).sum(axis=1) >= MIN_MATCHES]
                a.append(at)
                b.append(at + step)
            label = _local_labels(len(node), np.concatenate(a), np.concatenate(b))
            # A run that began in an earlier batch keeps its hub; the smallest class is the hub of a new one, so that the trees agree.
            least = node.copy()
            np.minimum.at(least, label, node)
            to = np.where(label < old, hub[label], least[label])
            links = np.unique(np.stack([hub, to], axis=1)[hub != to], axis=0)
            hub = to
            none = pa.nulls(len(links), pa.int32()), pa.nulls(len(links), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), *none], names=["u", "v", "tree", "turned"])
            if not borders:
                if seen < WINDOW:
                    yield _border(batch.slice(0, WINDOW - seen), stretch)
                end = batch.slice(max(0, n - WINDOW))
                last = end if last is None else pa.concat_batches([last, end])
                last = last.slice(max(0, last.num_rows - WINDOW))
            seen += n
            key, sig, node, part, hub = key[-WINDOW:], sig[-WINDOW:], node[-WINDOW:], part[-WINDOW:], hub[-WINDOW:]
        if last is not None and seen > WINDOW:
            yield _border(last.slice(max(0, last.num_rows - min(WINDOW, seen - WINDOW))), stretch)

    return run


def _border(rows: pa.RecordBatch, stretch: int) -> pa.RecordBatch:
    """Rows of a stretch's ends: the class as `u`, the stretch as `v`."""
    return pa.RecordBatch.from_arrays([rows.column(2), pa.array(np.full(rows.num_rows, stretch)), rows.column(0), rows.column(1)], names=["u", "v", "tree", "turned"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets of hashes."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    hashes = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    known, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    pick = shared[place]
    owner, column = owner[pick], column[place[pick]]
    width = int(shared.sum())
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    step = max(256, (4 << 20) // max(1, len(left) + len(right)))
    for lo in range(0, width, step):
        x, y = np.searchsorted(column, [lo, lo + step])
        dense = np.zeros((len(left) + len(right), min(step, width - lo)), dtype=np.float32)
        dense[owner[x:y], column[x:y] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity reaches the threshold, by exact counts."""
    both = intersections(left, right)
    union = np.array([len(s) for s in left], dtype=np.float64)[:, None] + np.array([len(s) for s in right], dtype=np.float64)[None, :] - both
    return np.nonzero((THRESHOLD[1] * both >= THRESHOLD[0] * union) & (both > 0))


MEMBER, ASKS, SHARED_MEMBER = 0, 1, 2


def _cell_links(nodes: np.ndarray, sides: np.ndarray, comps: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The confirmed links of a cell, reduced to one a class: with its component's smallest class, or smallest shared one.

    Where some ask, only their pairs with members of other components are looked at.
    """
    asks = np.flatnonzero(sides == ASKS)
    if len(asks):
        members = np.flatnonzero(sides != ASKS)
        if not len(members):
            return np.zeros((0, 2), np.int64)
        a, b = linked([sets[i] for i in asks], [sets[i] for i in members])
        a, b = asks[a], members[b]
        keep = comps[a] != comps[b]
    else:
        a, b = linked(sets, sets)
        keep = a < b
    a, b = a[keep], b[keep]
    by_node = np.argsort(nodes, kind="stable")  # rows that share an id are one node
    same = np.flatnonzero(nodes[by_node][1:] == nodes[by_node][:-1])
    label = _local_labels(len(nodes), np.concatenate([a, by_node[same]]), np.concatenate([b, by_node[same + 1]]))
    order = np.lexsort((nodes, sides != SHARED_MEMBER, label))
    _, first, sizes = np.unique(label[order], return_index=True, return_counts=True)
    links = np.stack([nodes[order], np.repeat(nodes[order][first], sizes)], axis=1)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _confirm(k: int):
    """Rows (cell string, node, side, comp, text) sorted by cell to confirmed links."""

    def run(batches):
        cell, rows = None, []

        def done():
            links = np.zeros((0, 2), np.int64)
            if len(rows) > 1:
                node, side, comp, sets = zip(*rows, strict=True)
                links = _cell_links(np.array(node), np.array(side), np.array(comp), list(sets))
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

        for batch in batches:
            for lo, hi in tk.slices(batch.column(4)):
                part = batch.slice(lo, hi - lo)
                for c, *row, own in zip(*(part.column(i).to_pylist() for i in range(4)), shingle_sets(part.column(4), k), strict=True):
                    if c != cell:
                        yield done()
                        cell, rows = c, []
                    rows.append((*row, own))
        yield done()

    return run


def _confirmed(rows: DataFrame, k: int) -> DataFrame:
    parted = rows.select("cell", "node", "side", "comp", "text").repartition("cell").sortWithinPartitions("cell")
    return parted.mapInArrow(tidy(_confirm(k)), "u long, v long")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """`nodes`: (node, sig), written.  Links that connect the candidate groups; each `u` has few."""
    turned = [F.struct(F.lit(t).alias("tree"), F.expr(f"substring(concat(sig, sig), {t * STRIDE + 1}, {POSITIONS})").alias("turned")) for t in range(TREES)]
    rows = nodes.select("node", F.explode(F.array(turned)).alias("x")).select("x.tree", "x.turned", "node")
    order = "tree", "turned", "node"
    found = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_forest_scan(False)), "u long, v long, tree int, turned binary"), "forest")
    ends = found.where("tree IS NOT NULL").select("tree", "turned", F.col("u").alias("node"), F.col("v").alias("stretch"))
    across = ends.repartition("tree", F.substring("turned", 1, MIN_DEPTH)).sortWithinPartitions(*order).mapInArrow(tidy(_forest_scan(True)), "u long, v long, tree int, turned binary")
    return found.where("tree IS NULL").select("u", "v").union(across.select("u", "v"))


def _texts(documents: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """`members` with the text of each node: one more scan of the texts, of which only candidates go on, also to a shuffle."""
    texts = documents.select(F.col("doc_id").alias("node"), "text")
    if n <= BROADCAST_IDS:
        return texts.join(F.broadcast(members), "node")
    some = texts.where("node IS NOT NULL").where(likely(members.select(F.xxhash64("node").alias("hash")), n, F.xxhash64("node")))
    return some.join(members.hint("shuffle_hash"), "node")


def _described(documents: DataFrame, k: int) -> DataFrame:
    rows = documents.select("doc_id", "text", text_key(F.col("text")).alias(TEXT_KEY))
    return stash(rows.mapInArrow(tidy(_describe(k)), f"doc_id long, n_shingles long, h1 long, h2 long, sig binary, {TEXT_KEY} long"), "signatures")


def _judged(documents: DataFrame, k: int) -> DataFrame:
    described = _described(documents, k)
    classes = stash(described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig")), "classes")
    groups = star_groups(candidate_links(classes.select("node", "sig"))).join(classes.groupBy("node").agg(F.max("n_shingles").alias("n")), "node")
    cells = F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_SHINGLES)).cast("int")
    large = stash(groups.groupBy("label").agg(cells.alias("cells")).where("cells > 1"), "large-groups")
    sized = stash(groups.join(large, "label", "left"), "groups")
    total, n_large = sized.agg(F.count("*"), F.count("cells")).first()
    none = F.lit(0).cast("long").alias("comp")
    small = sized.where("cells IS NULL").select("node", F.col("label").cast("string").alias("cell"), F.lit(MEMBER).alias("side"), none)
    # A small group lies whole in one cell, so its links already name each component's smallest node.
    found = stash(_confirmed(_texts(documents, small, total), k).select(F.col("u").alias("node"), F.col("v").alias("label")), "links")
    if n_large:
        found = found.unionByName(components(_large_links(_texts(documents, sized.where("cells IS NOT NULL"), n_large), k)))
    links = stash(classes.select("n_shingles", "h1", "h2", "node").join(found, "node", "left").select("n_shingles", "h1", "h2", F.coalesce("label", "node").alias("component")), "members")
    component = F.coalesce("component", "doc_id")
    return described.join(links, ["n_shingles", "h1", "h2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), TEXT_KEY
    )


def near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `documents` (doc_id long, text string)."""
    return _judged(documents, shingle_words).drop(TEXT_KEY)


def one_of_each_group(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of `documents`, all columns, that stay: of each group of near-duplicates the smallest id."""
    return without(documents, stash(_judged(documents, shingle_words).where("NOT kept").select("doc_id", TEXT_KEY), "copies"))


def _within_cells(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Links found within the cells of each group, and (label, node, n, cells, block, comp, main) by them."""
    firsts = rows.groupBy("label", "block").agg(F.min(F.struct("rank", "node")).alias("first")).select("label", "first.*")
    shared = stash(firsts.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("rank"))).where(F.col("nth") <= SHARED).select("label", "node", F.lit(SHARED_MEMBER).alias("side")), "shared")
    marked = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, ["label", "node"], "left").withColumn("side", F.coalesce("side", F.lit(MEMBER)))
    blocks = F.when(F.col("side") == MEMBER, F.array("block")).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))
    inside = marked.select("label", "node", "side", F.lit(0).cast("long").alias("comp"), F.explode(blocks).alias("block"), "text")
    links = stash(_confirmed(inside.withColumn("cell", F.concat_ws("/", "label", "block")), k), "links")
    comp = star_groups(links).withColumnRenamed("label", "comp")
    placed = stash(rows.select("label", "node", "n", "cells", "block").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    main = stash(placed.groupBy("label", "comp").agg(F.count("*").alias("m")).groupBy("label").agg(F.max(F.struct("m", "comp"))["comp"].alias("main")), "main")
    return links, placed.join(main, "label")


def _large_links(rows: DataFrame, k: int) -> DataFrame:
    """Confirmed links of groups of more than a cell, (label, node, n, cells, text): within cells first, then of what is still apart."""
    block = F.pmod(F.xxhash64("node"), F.col("cells").cast("long")).cast("int")
    rows = stash(rows.withColumn("block", block).withColumn("rank", F.xxhash64(F.lit(11), "node")), "large-texts")
    links, placed = _within_cells(rows, k)
    apart = F.col("comp") != F.col("main")
    stripes = placed.where(apart).groupBy("label").agg(F.ceil(F.count("*") / CELL).cast("int").alias("stripes"))
    open_ = stash(placed.join(stripes, "label").select("label", "node", "n", "cells", "block", "comp", apart.alias("apart"), "stripes"), "open")
    if open_.isEmpty():
        return links
    texts = rows.select("label", "node", "text")
    links = links.union(_grid_links(open_.where(F.col("stripes") <= GRID_STRIPES), texts, k))
    many = open_.where(F.col("stripes") > GRID_STRIPES)
    return links if many.isEmpty() else links.union(_prefix_links(many, texts, k))


def _grid_links(placed: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Links of the classes that are apart with all others of their group, stripe by cell."""
    stripe = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("stripes").cast("long")).cast("int")
    asks = placed.where("apart").withColumn("stripe", stripe).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    answers = placed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    cell = F.concat_ws("/", "label", "block", "stripe").alias("cell")
    both = asks.select("label", cell, "node", F.lit(ASKS).alias("side"), "comp").union(answers.select("label", cell, "node", F.lit(MEMBER).alias("side"), "comp"))
    return stash(_confirmed(both.join(texts, ["label", "node"]), k), "links")


def _explode_sets(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi in tk.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column(1), k)
                owner = np.repeat(np.arange(hi - lo), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["node", "shingle"])

    return run


def _prefix_links(placed: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """As `_grid_links`, of classes that share a rare shingle; the grid is left for those that share a frequent one."""
    some = texts.join(placed.select("label", "node"), ["label", "node"])
    tokens = stash(some.select("node", "text").mapInArrow(tidy(_explode_sets(k)), "node long, shingle long"), "shingles").join(placed.select("label", "node", "n", "comp", "apart"), "node")
    often = tokens.groupBy("label", "shingle").agg(F.count("*").alias("often"))
    by_rarity = Window.partitionBy("label", "node").orderBy("often", "shingle")
    length = F.col("n") - F.ceil(F.col("n") * THRESHOLD[0] / THRESHOLD[1]) + 1
    prefix = stash(tokens.join(often, ["label", "shingle"]).withColumn("place", F.row_number().over(by_rarity)).where(F.col("place") <= length).drop("place", "often"), "prefixes")
    lists = prefix.groupBy("label", "shingle").agg(F.count("*").alias("m"), F.max("apart").alias("asked"), (F.min("comp") != F.max("comp")).alias("mixed"))
    prefix = stash(prefix.join(lists.where("asked AND mixed").select("label", "shingle", "m"), ["label", "shingle"]), "postings")
    rare = prefix.where(F.col("m") <= POSTINGS)
    a, b = (x.select("label", "shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "comp", "apart")]) for x, side in ((rare.where("apart"), "a"), (rare, "b")))
    fits = F.least("n_a", "n_b") * THRESHOLD[1] >= F.greatest("n_a", "n_b") * THRESHOLD[0]
    once = "comp_a <> comp_b AND (NOT apart_b OR node_a < node_b)"
    pairs = stash(a.join(b, ["label", "shingle"]).where(once).where(fits).select("label", "node_a", "comp_a", "node_b", "comp_b").distinct(), "pairs")
    # Each asking class with its partners, a cell's worth at a time.
    parts = pairs.groupBy("label", "node_a").agg(F.ceil(F.count("*") / CELL).cast("long").alias("parts"))
    dealt = pairs.join(parts, ["label", "node_a"]).withColumn("cell", F.concat_ws("/", "label", "node_a", F.pmod(F.xxhash64("node_b"), F.col("parts"))))
    asks = dealt.select("label", "cell", F.col("node_a").alias("node"), F.lit(ASKS).alias("side"), F.col("comp_a").alias("comp")).distinct()
    members = dealt.select("label", "cell", F.col("node_b").alias("node"), F.lit(MEMBER).alias("side"), F.col("comp_b").alias("comp"))
    links = stash(_confirmed(asks.union(members).join(texts, ["label", "node"]), k), "links")
    hot = stash(placed.join(prefix.where(F.col("m") > POSTINGS).select("label", "node").distinct(), ["label", "node"]), "hot")
    stripes = hot.where("apart").groupBy("label").agg(F.ceil(F.count("*") / CELL).cast("int").alias("stripes"))
    return links.union(_grid_links(hot.drop("stripes").join(stripes, "label"), texts, k))


ORACLE = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, (greatest(len(w) - 3, 1) + 1)::BIGINT)) AS i FROM low WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.root, links.y FROM reach JOIN links ON reach.node = links.x
), components AS (
  SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node
)
SELECT low.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, low.doc_id = component_id AS kept
FROM low LEFT JOIN sizes USING (doc_id) JOIN components USING (doc_id)
"""

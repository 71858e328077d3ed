"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits, and linked documents form
components.

Every search is one of vantage-point trees: fingerprints are partitioned by their Hamming
distance from a vantage point, triangle bounds prune whatever can't lie within the radius, and
what lies near the boundary of a part also visits the part beyond it, so pairs are exact.

On 64 bits, distances between unlike fingerprints crowd around 32, and a tree over all of them
would send some two thirds down both sides of every split. What a tree visits is therefore
bounded first: the bits are dealt into ``RADIUS + c`` chunks, and two linked fingerprints agree
wholly on some ``c`` of these. There is one forest for each choice of ``c`` chunks, and in it one
tree for each value they take. ``c`` grows with the number of fingerprints, so that a tree holds
some hundreds of them at any size. Trees work on all bits:

* a tree of more than ``SHARD_CAP`` fingerprints is split over tasks into rings around a vantage
  point; a ring is wider than the radius, so each fingerprint visits the neighbouring rings only;
* a task grows all its trees level by level at once, down to single fingerprints. At a node the
  vantage point meets all others, which then go to the near or the far side; a branch whose
  members are joined already ends.

Equal fingerprints are one class from the start, counted on the map side, so thousands of
copies cost one row each task. Only fingerprints and ids are shuffled, never texts.
A task gives back a spanning star for each component it found, not all its pairs.

Defined cases: a null, empty or white-space text has no words and fingerprint zero, and links
like any other; fewer than four words are one shingle; repeated rows and repeated ids are
rows of their own; a null id takes part and is smallest in no component (a component of
null ids alone has a null component_id); an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import checkpointed, map_batches, row_slices, spread_join, utf8
from latora.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a tree, about, where they are spread evenly.
TREE_SIZE = 256
SHARD_CAP = 1 << 20
RING = RADIUS + 1
#: Rows of whole trees that a task searches at once.
SEARCH_ROWS = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    shingles = list(zip(*(words[k:] for k in range(SHINGLE))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles[at : at + 65536]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1024):
            found = np.array([fingerprint(utf8(t)) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)), run, "doc_id long, text_hash long, fp long")


def _apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after links are added; a root is the least of its component, and its own root."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def forest_links(tree: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Links that join what lies within the radius in each tree, and how many members nodes visited.

    ``tree`` numbers the trees from 0. Links are those among ``home`` members, and of these
    with the others, which are guests from beyond a boundary. They come as (fingerprint, least
    fingerprint of its component).
    """
    value, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(value))
    visits = 0
    while len(tree):
        n = int(tree.max()) + 1
        vantage = np.full(n, -1)
        vantage[tree[home]] = node[home]
        # branches without a home member, and those whose members are joined already, end
        open_ = np.zeros(n, bool)
        of = vantage[tree]
        open_[tree[(of >= 0) & (root[node] != root[of])]] = True
        going = open_[tree]
        tree, node, home, of = tree[going], node[going], home[going], of[going]
        d = _apart(value[node], value[of]).astype(np.int64)
        visits += len(node)
        near = d <= RADIUS
        root = _joined(root, node[near], of[near])
        rest = node != of
        tree, node, home, d = tree[rest], node[rest], home[rest], d[rest]
        # the mean distance splits the home members; no side is empty unless all lie equally far
        count = np.bincount(tree[home], minlength=n)
        split = np.bincount(tree[home], d[home], minlength=n).astype(np.int64) // np.maximum(count, 1)
        at = split[tree]
        inner, outer = d <= at, d > at
        to_inner = inner | (~home & (d - RADIUS <= at))
        to_outer = outer | (d + RADIUS > at)
        parts = [(2 * tree[to_inner], node[to_inner], home[to_inner]), (2 * tree[to_outer] + 1, node[to_outer], (home & outer)[to_outer])]
        tree, node, home = (np.concatenate(x) for x in zip(*parts))
        used = np.zeros(2 * n, bool)
        used[tree[home]] = True
        keep = used[tree]
        tree, node, home = (np.cumsum(used) - 1)[tree[keep]], node[keep], home[keep]
    moved = root != np.arange(len(value))
    return value[moved], value[root[moved]], visits


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by tree, some whole trees at a time."""

    def links(parts):
        key, fp, home = (np.concatenate(x) for x in zip(*parts))
        number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        a, b, _ = forest_links(number, fp, home)
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in (a, b)], names=["a", "b"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        part = (key, batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
        # the last tree of a batch may go on in the next one
        cut = int(np.searchsorted(key, key[-1]))
        ended = cut or held and held[-1][0][-1] != key[0]
        if ended and size + cut >= SEARCH_ROWS:
            yield from links([*held, tuple(x[:cut] for x in part)])
            held, size = [tuple(x[cut:] for x in part)], len(key) - cut
        else:
            held.append(part)
            size += len(key)
    if held:
        yield from links(held)


def _split_hot(shards: DataFrame, cap: int) -> DataFrame:
    """Rings in place of shards with more than ``cap`` fingerprints at home.

    Shards that large number at most the rows over the cap; they are collected in that
    bounded form. Splitting ends when none is left, or when the largest gets no smaller.
    """
    level, largest = 0, None
    while True:
        hot = shards.filter("home").groupBy("shard").agg(F.count("*").alias("n"), F.min("fp").alias("vantage"), F.max("fp").alias("other")).filter(F.col("n") > cap).collect()
        now = max((r.n for r in hot), default=0)
        if not hot or largest is not None and level % 2 == 0 and now >= largest:
            return shards
        largest = now if level % 2 == 0 else largest
        spark = shards.sparkSession
        # another vantage point at each level: rings around the same one would not split again
        points = [(r.shard, r.vantage if level % 2 == 0 else r.other) for r in hot]
        points = F.broadcast(spark.createDataFrame(points, "shard long, vantage long"))
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        own = F.floor(d / RING).cast("int")
        reach = F.sequence(F.floor(F.greatest(d - RADIUS, F.lit(0)) / RING).cast("int"), F.floor((d + RADIUS) / RING).cast("int"))
        # a row at home goes to its own ring, and as a visitor to the next; visitors go wherever they may meet one
        rings = F.when(F.col("home"), F.array_distinct(F.array(own, F.floor((d + RADIUS) / RING).cast("int")))).otherwise(reach)
        cold = shards.join(points, "shard", "left_anti")
        split = shards.join(points, "shard").withColumn("own", own).withColumn("ring", F.explode(rings))
        split = split.select(F.xxhash64("shard", "ring", F.lit(level)).alias("shard"), "fp", (F.col("home") & (F.col("ring") == F.col("own"))).alias("home"))
        shards = checkpointed(cold.select("shard", "fp", "home").unionByName(split))
        level += 1


def forest_masks(n: int, size: int = TREE_SIZE) -> list[int]:
    """The bits, one mask for each forest, on which trees agree: for n fingerprints, about ``size`` to a tree.

    ``RADIUS`` differing bits touch at most as many of the chunks, so linked fingerprints agree on all the
    chunks of some mask. At most 4 chunks are chosen, of 32 bits together.
    """
    for chosen in range(1, 5):
        chunks = RADIUS + chosen
        edges = [64 * k // chunks for k in range(chunks + 1)]
        masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in pick) for pick in itertools.combinations(range(chunks), chosen)]
        if n <= size << (64 * chosen // chunks):
            break
    return masks


def fingerprint_links(classes: DataFrame, cap: int = SHARD_CAP, size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within the radius of each other."""
    masks = [m - (m >> 63 << 64) for m in forest_masks(classes.count(), size)]
    trees = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)))
    shards = _split_hot(classes.select(F.explode(trees).alias("shard"), "fp", F.lit(True).alias("home")), cap)
    return map_batches(shards.repartition("shard").sortWithinPartitions("shard"), _search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = SHARD_CAP) -> DataFrame:
    """(doc_id, text_hash, fp, fingerprint, component_id, root) of every row; root is the component's root fingerprint."""
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(fingerprint_links(classes, cap))
    linked = checkpointed(classes.join(roots, classes.fp == roots.node).select("fp", "least", "root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = spread_join(linked, smallest, "root").select("fp", "component_id", "root")
    groups = classes.join(known, "fp", "left").select("fp", "n", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return spread_join(marked, checkpointed(groups), "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """One row of each component, all columns kept: a row of its smallest id, of rows alike in id and text only one.

    Rows of null ids alone are one component by their root fingerprint. The rows to keep are
    found from ids and hashes; texts are shuffled once, to meet them. ``found`` gives the components
    of another search, as (doc_id, text_hash, root) of every row.
    """
    if found is None:
        found = near_duplicates(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    # plain key columns without nulls, by which grouping and join share a partitioning
    keys = ["i", "no_id", "h"]
    keep = found.groupBy("root").agg(first.alias("k")).select(F.coalesce("k.doc_id", F.lit(0)).alias("i"), F.col("k.no_id").alias("no_id"), F.coalesce("k.text_hash", F.lit(0)).alias("h"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(F.col(text_col)).alias("h"), row)
    # rows alike are few after each task has left one of them, however many there are
    once = rows.groupBy(*keys).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    # a key is one row of three numbers in ``keep``, so hashing that side spares a sort of the texts
    kept = once.join(keep.hint("shuffle_hash"), keys)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))

"""Documents alike in five-word shingles: all pairs with a Jaccard similarity of at least 0.8.

SimHash within a few bits misses most such pairs: at a similarity of 0.8 fingerprints of 64 bits
lie about 10 bits apart, often 15, and a search as wide as that meets a good part of all pairs.
This search therefore takes whole shingle sets in place of fingerprints. Their Hamming distance,
the number of shingles that only one of two texts has, is a metric as well, and two texts are
alike if it is at most a ninth of their sizes together. Vantage points, triangle bounds and
overlapping rings work as on fingerprints:

* Bands of hashed minima bound what is visited: ``BANDS`` bands of ``ROWS`` minima, of which a
  pair of similarity s shares one with probability ``1 - (1 - s ** ROWS) ** BANDS``. At 0.8 a pair is
  missed once in 2e7, and less often above. Texts with the same set of shingles are one class.
* In each band's group the class that shares most with others is the vantage point. It meets all
  others, and those within the radius are joined. Where some are left, the best placed of these
  is a second vantage point for them.
* Pairs that are still apart are found by what they do not share with the vantage point. Such a
  pair has differences in common, so many that their rarest ones meet (``_crossing``): only pairs
  of neighbouring rings, by distance from the vantage point, that have a rare difference in
  common are compared. No group is compared pair by pair.

Whatever links here has been compared by whole shingle sets. Minima and class numbers are shuffled;
texts are shuffled once, for the classes that have a candidate, to rebuild their shingles. Links by
SimHash fingerprints can join them (``bit_links``), and then both are one graph of classes.

Defined cases: words are those of the fingerprint; fewer than five words are one shingle; texts
without words are alike and like nothing else; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import checkpointed, map_batches, row_slices, spread_join, utf8
from latora.llm.components import components
from latora.llm.simhash_dedup import fingerprint, fingerprint_links

SHINGLE = 5
#: Sets x and y have a Jaccard similarity of 4/5 or more if the number of shingles in only one of
#: them is at most (|x| + |y|) / APART; their sizes then differ by a factor of 5/4 at most.
APART = 9
#: Rings around a vantage point of s shingles are s / RINGS wide.
RINGS = 16
SEED = 42
ROWS = 4
BANDS = 32
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_BLOCK = 4096


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)))], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band of minima, as signed longs; none for an empty set."""
    if not len(found):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        mixed = found[at : at + _BLOCK, None] * _FACTORS + _TERMS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    raw = least.tobytes()
    width = 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[width * k : width * (k + 1)], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_bits: bool = False) -> DataFrame:
    """(doc_id, text_hash, node, bands, fp) of every row; node numbers the set of shingles, fp is the SimHash fingerprint as a signed long, null without ``by_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            texts = [utf8(t) for t in part.column(1).to_pylist()]
            sets = [shingles(t) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)) if by_bits else pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node), bands, fp], names=["doc_id", "text_hash", "node", "bands", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)), run, "doc_id long, text_hash long, node long, bands array<long>, fp long")


def _sets(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """(node, found) of the classes in ``needed``, which has a text_hash for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            sets = pa.array([shingles(utf8(t)).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "found"])

    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = texts.join(needed.hint("shuffle_hash"), "text_hash").select("node", "text")
    return map_batches(texts, run, "node long, found array<long>").dropDuplicates(["node"])


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of both sets, their distance, and whether they link."""
    x, y = (sets.select(F.col("node").alias(c), F.col("found").alias(f"{c}_set")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")
    size = lambda c: F.size(f"{c}_set").alias(f"size_{c}")
    apart = F.size("a_set") + F.size("b_set") - 2 * F.size(F.array_intersect("a_set", "b_set"))
    sized = both.select("a", "b", size("a"), size("b"), apart.alias("apart"))
    return sized.withColumn("linked", APART * F.col("apart") <= F.col("size_a") + F.col("size_b"))


def _centered(rows: DataFrame) -> DataFrame:
    """(key, node, center) of rows (key, node, score): the highest scored node of each key is its center."""
    centers = rows.groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("center"), F.count("*").alias("n")).filter("n > 1")
    return spread_join(rows, checkpointed(centers), "key").drop("n")


def _pairs(centered: DataFrame) -> DataFrame:
    return centered.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()


def _crossing(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one vantage point that may link though their labels differ.

    ``members`` has (center, node, size, size_center, apart, linked, label). With E the difference
    of a set from the center's and e its size, the distance of x and y is e_x + e_y - 2 |E_x & E_y|,
    so they link if they have ``need`` = (e_x + e_y - (|x| + |y|) / APART) / 2 differences in common, or
    more. Of two members one at least doesn't link with the center, and then ``need`` is above 0.
    In one order of all differences, rare ones first, the first common one stands at a place,
    from 0, of at most e_x - need in E_x and at most e_y - need in E_y. As |y| <= 5/4 |x|, that place
    in E_x is open to partners of e_y up to e_x + |x| / 4 - 2 place, and e_y is no less than e_x - |x| / 4.
    """
    x, c = sets.select("node", F.col("found").alias("x")), sets.select(F.col("node").alias("center"), F.col("found").alias("c"))
    differing = F.concat(F.array_except("x", "c"), F.array_except("c", "x"))
    spread = members.select("center", "node").join(x, "node").join(c, "center").select("center", "node", F.explode(differing).alias("shingle"))
    spread = checkpointed(spread)
    often = checkpointed(spread.groupBy("center", "shingle").agg(F.count("*").alias("often")).filter("often > 1"))
    # differences of one member alone come first in its order: they are counted, and needn't be kept
    order = spread.join(often, ["center", "shingle"]).groupBy("center", "node").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("order"))
    placed = members.join(order, ["center", "node"]).select("*", F.posexplode("order").alias("k", "s"))
    placed = placed.withColumn("place", F.col("k") + F.col("apart") - F.size("order"))
    width = F.greatest(F.lit(1), F.floor(F.col("size_center") / RINGS))
    ring = lambda e: F.floor(e / width).cast("int")
    first = F.greatest(F.lit(0), F.col("apart") - F.col("size") / 4)
    last = F.col("apart") + F.col("size") / 4 - 2 * F.col("place")
    reach = F.when(last >= first, F.sequence(ring(first), ring(last)))
    placed = placed.select("center", "node", "size", "apart", "linked", "label", "place", F.col("s.shingle").alias("shingle"), ring(F.col("apart")).alias("own"), F.explode(reach).alias("other"))
    placed = checkpointed(placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("own", "other"))
    keys = ["center", "shingle", "low", "high"]
    left = placed.filter("NOT linked").select(*keys, *(F.col(n).alias(f"{n}_a") for n in ("node", "size", "apart", "label", "place")))
    right = placed.select(*keys, *(F.col(n).alias(f"{n}_b") for n in ("node", "size", "apart", "label", "place", "linked")))
    sizes, gap = F.col("size_a") + F.col("size_b"), F.col("apart_a") - F.col("apart_b")
    both = left.join(right, keys).filter((F.col("linked_b") | (F.col("node_a") < F.col("node_b"))) & (F.col("label_a") != F.col("label_b")))
    both = both.filter(4 * F.greatest("size_a", "size_b") <= 5 * F.least("size_a", "size_b")).filter(APART * F.abs(gap) <= sizes)
    both = both.filter((2 * APART * F.col("place_a") <= APART * gap + sizes) & (2 * APART * F.col("place_b") <= sizes - APART * gap))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_links(marked: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b) between classes that join all pairs within the radius."""
    classes = checkpointed(marked.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands")))
    rows = classes.select("node", F.explode("bands").alias("key"))
    shared = checkpointed(spread_join(rows, checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")), "key"))
    # a class in many and large groups is a good vantage point: it lies amid the others
    scored = shared.groupBy("node").agg(F.sum("n").alias("score"))
    grouped = checkpointed(_centered(shared.drop("n").join(scored, "node")))
    sets = checkpointed(_sets(docs, classes.select("node", "text_hash").join(scored.select("node"), "node"), text_col))
    met = checkpointed(_met(_pairs(grouped), sets))
    known = met.select(F.col("a").alias("center"), F.col("b").alias("node"), F.col("size_b").alias("size"), F.col("size_a").alias("size_center"), "apart", "linked")
    free = grouped.join(known.filter("NOT linked").select("center", "node"), ["center", "node"]).select("key", "node", "score")
    again = checkpointed(_met(_pairs(_centered(free)), sets))
    # members with the same label are joined already
    label = again.filter("linked").select(F.col("b").alias("node"), F.col("a").alias("second")).unionByName(again.select(F.col("a").alias("node"), F.col("a").alias("second")))
    label = label.groupBy("node").agg(F.min("second").alias("second"))
    open_ = checkpointed(known.groupBy("center").agg(F.count("*").alias("n"), F.bool_and("linked").alias("all")).filter("n > 1 AND NOT all"))
    members = spread_join(known, open_, "center").drop("n", "all").join(label, "node", "left")
    members = checkpointed(members.withColumn("label", F.when(F.col("linked"), F.col("center")).otherwise(F.coalesce("second", "node"))).drop("second"))
    links = [x.filter("linked").select("a", "b") for x in (met, again, _met(_crossing(members, sets), sets))]
    return links[0].unionByName(links[1]).unionByName(links[2])


def bit_links(marked: DataFrame) -> DataFrame:
    """Links (a, b) between classes that join all whose SimHash fingerprints lie within its radius, by vantage-point trees; equal fingerprints are a star."""
    pairs = checkpointed(marked.select("fp", "node").distinct())
    least = checkpointed(pairs.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    equal = spread_join(pairs, least.filter("n > 1"), "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")) for c in "ab")
    near = fingerprint_links(least).join(x, "a").join(y, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return near.unionByName(equal)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_bits: bool = False) -> DataFrame:
    """(doc_id, text_hash, root) of every row; rows of one component have one root.

    With ``by_bits`` fingerprints within the radius of SimHash link as well, in the same components.
    """
    marked = checkpointed(classes_of(docs, id_col, text_col, by_bits))
    links = similar_links(marked, docs, text_col)
    if by_bits:
        links = links.unionByName(bit_links(marked))
    roots = components(links)
    counted = marked.groupBy("node").agg(F.count("*").alias("n"))
    rooted = checkpointed(counted.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    return spread_join(marked.select("doc_id", "text_hash", "node"), rooted, "node").select("doc_id", "text_hash", "root")

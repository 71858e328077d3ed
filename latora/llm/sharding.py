"""Sharding by fixed virtual slots (DataFrame and SQL functions only).

Every record hashes into one of ``N_SLOTS`` virtual slots. Bytes are summed per slot, and a
small versioned table maps slots to shards; it is written to a folder and read back to place
records. Balancing and growing edit that table and write its next version; records never hash
again. The slot table has ``N_SLOTS`` rows whatever the corpus holds, so it is the one thing that
is brought to the driver and broadcast.

Rows alike in id, size and checksum are counted on the map side, dealt into bundles, and become
rows again at the very end. A bundle hashes on its own, so that even a third of all rows being
alike spreads over the slots.

Law of the assignment: ``bytes``, shard sizes are near equal.

Defined cases: a null text has 0 bytes and crc32 0 (as an empty one); a null id hashes like
any other value; rows with the same id and text are separate records; an empty table gives no
rows and a map of empty slots; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latora.session import shared_folder

N_SLOTS = 8192
N_SHARDS = 40
ROW_OVERHEAD = 16
#: Copies in a bundle, and bundles that one group of copies has at most, in larger bundles then.
BUNDLE, MOST_BUNDLES = 8, 1 << 20
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_rows long, slot_bytes long"


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def record_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Id, size, crc32, bundle, its number of copies, and virtual slot; the text itself goes no further."""
    record = ["doc_id", "size", "text_crc32"]
    sized = docs.select(F.col(id_col).alias("doc_id"), record_size(F.col(text_col)).alias("size"), record_crc(F.col(text_col)).alias("text_crc32"))
    alike = sized.groupBy(*record).agg(F.count("*").alias("n"))
    alike = alike.withColumn("most", F.greatest(F.lit(BUNDLE), F.ceil(F.col("n") / MOST_BUNDLES)))
    dealt = alike.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("most")))))
    dealt = dealt.withColumn("copies", F.least("most", F.col("n") - F.col("bundle") * F.col("most"))).drop("n", "most")
    return dealt.withColumn("virtual_slot", F.pmod(F.xxhash64(*record, "bundle"), F.lit(n_slots)).cast("int"))


def slot_totals(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, rows, bytes) of the slots in use: at most as many rows as there are slots."""
    totals = slotted.groupBy("virtual_slot").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("b"))
    return sorted((r.virtual_slot, r.n, r.b) for r in totals.collect())


def first_map(totals: list[tuple[int, int, int]], n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> list[tuple[int, int, int, int, int]]:
    """Version 1: slots by descending bytes, each to the lightest shard so far."""
    known = {s: (n, b) for s, n, b in totals}
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for slot in sorted(range(n_slots), key=lambda s: (-known.get(s, (0, 0))[1], s)):
        n, b = known.get(slot, (0, 0))
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + b, shard))
        out.append((1, slot, shard, n, b))
    return sorted(out, key=lambda r: r[1])


def rebalance(current: list[tuple[int, int, int, int, int]], totals: list[tuple[int, int, int]], n_shards: int, tolerance: float = 0.01) -> list[tuple[int, int, int, int, int]]:
    """The next version: as few slots as are needed move from heavy to light shards.

    Takes the newest byte totals. Slots stay where they are unless their shard is heavier
    than the mean by more than ``tolerance``, or their shard is gone. A larger ``n_shards``
    fills the new shards by moves from the heaviest ones.
    """
    known = {s: (n, b) for s, n, b in totals}
    version = 1 + max((r[0] for r in current), default=0)
    at = {r[1]: r[2] for r in current}
    load = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    loose = []
    for slot, shard in sorted(at.items()):
        if shard < n_shards:
            load[shard] += known.get(slot, (0, 0))[1]
            held[shard].append(slot)
        else:
            loose.append(slot)
    weight = lambda s: known.get(s, (0, 0))[1]
    mean = sum(load[s] for s in range(n_shards)) / n_shards + sum(map(weight, loose)) / n_shards
    for shard in range(n_shards):
        held[shard].sort(key=lambda s: (weight(s), s))
        while load[shard] > mean * (1 + tolerance) and held[shard]:
            fits = [s for s in held[shard] if 0 < weight(s) <= load[shard] - mean]
            if not fits:
                break
            slot = fits[-1]
            held[shard].remove(slot)
            load[shard] -= weight(slot)
            loose.append(slot)
    heap = [(load[s], s) for s in range(n_shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight(s), s)):
        w, shard = heapq.heappop(heap)
        heapq.heappush(heap, (w + weight(slot), shard))
        at[slot] = shard
    return [(version, slot, at[slot], *known.get(slot, (0, 0))) for slot in sorted(at)]


def map_frame(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, MAP_SCHEMA)


def save_map(spark: SparkSession, rows: list[tuple[int, int, int, int, int]], path: str) -> None:
    """Write one version of the map to a folder of its own; a version once written is an error to write again."""
    version = rows[0][0]
    map_frame(spark, rows).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """One version of a saved map, the newest unless named."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path).select("version", "virtual_slot", "shard", "slot_rows", "slot_bytes")
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return sorted(tuple(r) for r in stored.filter(F.col("version") == version).collect())


def next_map(spark: SparkSession, path: str, totals: list[tuple[int, int, int]], n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, first: bool = False) -> list[tuple[int, int, int, int, int]]:
    """Write the next version of the map in ``path`` and read it back: version 1 if it is the first, else the newest one edited."""
    rows = first_map(totals, n_shards, n_slots) if first else rebalance(load_map(spark, path), totals, n_shards)
    save_map(spark, rows, path)
    return load_map(spark, path, rows[0][0])


def assign(slotted: DataFrame, slot_map: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Shard and gapless place in the shard of each record.

    A place is the number of rows in the shard's earlier slots plus the place within the slot,
    so numbering needs the bundles of one slot together and never those of one shard.
    """
    spark = slotted.sparkSession
    before: dict[int, int] = {}
    rows = []
    for _, slot, shard, n, _ in sorted(slot_map, key=lambda r: r[1]):
        rows.append((slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    starts = spark.createDataFrame(rows, "virtual_slot int, shard int, first_place long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "bundle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slotted.withColumn("end", F.sum("copies").over(order))
    return (
        placed.join(F.broadcast(starts), "virtual_slot", "left")  # every slot has a start; an inner join would test it for null first
        .withColumn("place", F.explode(F.sequence(F.col("end") - F.col("copies"), F.col("end") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_place") + F.col("place")).alias("slot"), "virtual_slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Assign every record by a stored map: doc_id, size, text_crc32, shard, slot, virtual_slot.

    A map in ``map_path`` is edited for the present bytes, and its next version is the one
    assigned by. Without ``map_path`` a first version is written to a new folder beside the checkpoints.
    """
    slotted = with_slots(docs, id_col, text_col, n_slots)
    first = map_path is None
    path = f"{shared_folder(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}" if first else map_path
    return assign(slotted, next_map(docs.sparkSession, path, slot_totals(slotted), n_shards, n_slots, first))

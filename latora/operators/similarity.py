"""Cosine similarity of vectors: of pairs, of a few queries to a catalogue, and of all pairs in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.functions.ranking import durable, top_k_by

TINY = 1e-12
QUERY_BLOCK = 2048
PAIR_BLOCK = 2048
#: Blocks of the right side that a task meets one after the other.
RIGHT_BLOCKS = 8
#: Scores of a strip of one block with another are made, and handed on, at once.
STRIP = 128


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n < TINY, 1.0, n)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite scores of each row; of equals the first columns."""
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if score.shape[1] <= k:
        return np.nonzero(np.isfinite(score))
    least = np.partition(score, -k, axis=1)[:, -k]
    row, column = np.nonzero(score >= least[:, None])
    found = score[row, column]
    finite = np.isfinite(found)
    row, column, equal = row[finite], column[finite], (found == least[row])[finite]
    # of those equal to the least, each row has room for the first few
    room = k - np.bincount(row[~equal], minlength=len(score))
    nth = np.cumsum(equal)
    before = np.concatenate([[0], np.cumsum(np.bincount(row[equal], minlength=len(score)))])[row]
    keep = ~equal | (nth - before <= room[row])
    return row[keep], column[keep]


def _block_top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of some rows for each of some queries; ids break ties, as in the final ranking."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    score = q @ unit_rows(vectors)[order].T
    np.clip(score, -1.0, 1.0, out=score)
    if exclude_self:
        met = np.flatnonzero(np.isin(ids, query_ids))
        row, column = np.nonzero(query_ids[:, None] == ids[None, met])
        score[row, met[column]] = -np.inf
    row, column = _best(score, k)
    return query_ids[row], ids[column], score[row, column]


def query_topk(catalog: DataFrame, queries: DataFrame, k: int, id_col: str = "song_id", vector_col: str = "features", query_id: str = "query_id", exclude_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, pos): the k most similar rows to each query.

    Up to ``block`` queries are broadcast and multiplied with each batch of the catalogue. More
    are packed into blocks, and so is the catalogue; each pair of blocks meets in a task, without
    the driver. Either way a task hands on its own top k for each query only.
    """
    schema = f"{query_id} long, {id_col} long, score double"
    songs = catalog.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(query_id).cast("long").alias(query_id), F.col(vector_col).alias("v"))
    few = asked.limit(block + 1).collect()
    if len(few) <= block:
        shared = catalog.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few], np.int64), unit_rows(np.array([r[1] for r in few], float)) if few else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for batch in batches:
                if batch.num_rows and len(qid):
                    found = _block_top(qid, q, batch.column(0).to_numpy(), _vectors(batch.column(1)), k, exclude_self)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[query_id, id_col, "score"])

        out = songs.mapInArrow(run, schema)
    else:

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for i, qid, q, _, ids, vectors in _met_blocks(batches):
                if i != at and held:
                    yield _top_batch(held, query_id, id_col)
                found = _block_top(qid, unit_rows(q), ids, vectors, k, exclude_self)
                held = _merged(held, found, k) if i == at else found
                at = i
            if held:
                yield _top_batch(held, query_id, id_col)

        out = _pairs_of_blocks(_packed(asked, PAIR_BLOCK), _packed(songs, PAIR_BLOCK)).mapInArrow(meet, schema)
    return top_k_by(out, [query_id], k, F.desc("score"), id_col)


def _merged(one: tuple, other: tuple, k: int) -> tuple:
    """The best k of each query in two results; ids break ties."""
    query, ids, score = (np.concatenate(x) for x in zip(one, other))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
    keep = place < k
    return query[keep], ids[keep], score[keep]


def _top_batch(found: tuple, query_id: str, id_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=[query_id, id_col, "score"])


def _packed(df: DataFrame, size: int) -> DataFrame:
    """(block, ids, vectors) of a table (id, vector): a row for each block of at most ``size`` rows, as bytes.

    Neighbours stay in one block. Blocks are dealt to as many partitions and kept durably, once: every
    pair of them reads them again, and a second packing could differ.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors)], names=["ids", "vectors"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append((part.column(0).to_numpy(), _vectors(part.column(1))))
                at, n = at + part.num_rows, n + part.num_rows
                if n == size:
                    yield row(held)
                    held, n = [], 0
        if held:
            yield row(held)

    dealt = df.mapInArrow(pack, "ids binary, vectors binary").repartition(max(1, -(-df.count() // size)))
    return durable(dealt.withColumn("block", F.monotonically_increasing_id()), spent=True)


def _pairs_of_blocks(left: DataFrame, right: DataFrame, upper: bool = False) -> DataFrame:
    """Each block of the left with each of the right, as a product of kept partitions: no block is shuffled or kept again."""
    blocks = right.count()
    # few blocks are met one by one, so that tasks are enough
    right = right.coalesce(max(1, min(blocks, RIGHT_BLOCKS), -(-blocks // RIGHT_BLOCKS)))
    x, y = left.select(*(F.col(c).alias(f"{c}_i") for c in ("block", "ids", "vectors"))), right.select(*(F.col(c).alias(f"{c}_j") for c in ("block", "ids", "vectors")))
    return x.join(y.hint("shuffle_replicate_nl"), F.col("block_i") <= F.col("block_j") if upper else F.lit(True))


def _met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, ids, vectors) of the left and of the right, for each pair of blocks."""
    for batch in batches:
        for n in range(batch.num_rows):
            i, j = (batch.column(c)[n].as_py() for c in (0, 3))
            sides = []
            for c in (1, 4):
                ids = np.frombuffer(batch.column(c)[n].as_buffer(), np.int64)
                sides.append((ids, np.frombuffer(batch.column(c + 1)[n].as_buffer(), np.float64).reshape(len(ids), -1)))
            yield i, *sides[0], j, *sides[1]


def similarity_matrix(left: DataFrame, right: DataFrame, id_col: str = "song_id", vector_col: str = "features", rows_per_block: int = PAIR_BLOCK, upper: bool = False) -> DataFrame:
    """(i, j, score) of all pairs, as products of blocks. Nothing is broadcast, and a task holds a few blocks.

    ``upper`` keeps i < j of a table with itself; of two unlike blocks only one order is multiplied.
    """
    own = _packed(left.select(F.col(id_col).cast("long"), F.col(vector_col)), rows_per_block)
    other = own if upper else _packed(right.select(F.col(id_col).cast("long"), F.col(vector_col)), rows_per_block)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, left_ids, x, b, right_ids, y in _met_blocks(batches):
            x, y = unit_rows(x), unit_rows(y)
            for at in range(0, len(x), STRIP):
                score = np.clip(x[at : at + STRIP] @ y.T, -1.0, 1.0).ravel()
                ids = left_ids[at : at + STRIP]
                i, j = np.repeat(ids, len(right_ids)), np.tile(right_ids, len(ids))
                if upper:
                    if a != b:
                        i, j = np.minimum(i, j), np.maximum(i, j)
                    keep = i < j
                    if not keep.all():
                        i, j, score = i[keep], j[keep], score[keep]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(score)], names=["i", "j", "score"])

    return _pairs_of_blocks(own, other, upper).mapInArrow(product, "i long, j long, score double")

"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models, one of the target text and one of the raw corpus, are counts over
``BUCKETS`` hash buckets of words and word pairs. The log-weight of a document is the log-ratio
of its likelihoods under the two. Its n-grams aren't independent and the fitted ratios err:
chance moves the sum by about the root of its length n, and errors of the fit that its n-grams
share move it by n itself, the more the fewer labels there are. The sum is therefore tempered to
``TEMPER * (log_ratio - mean * n) / sqrt(a * n + b * n * n)``, where mean, a and b are fitted to
the held-out good documents (see below), so that these have mean 0 and variance near
``TEMPER ** 2`` at any length. Sampling without replacement by these weights is a top-k of
log-weight plus Gumbel noise.

The target is a bounded sample of labelled good documents (``TARGET_SAMPLE``, by a hash order
of their ids). Every other one of them fits the target model; the rest, held out, calibrate:
k is the number of documents that weigh no less than all but ``MISSED`` of the held-out ones,
or than all but ``MISSED`` of a normal distribution if that is more lenient, as a few held-out
documents tell little of their tail. The raw model counts every document.

Noise comes from a hash of the id and a seed, so a retried task draws the same. The k-th key
is found exactly by counting keys in ever finer ranges, ``DIGIT`` bits at a time; only those
bounded counts reach the driver. Of rows with the same key, all or none pass by the order of
their text's hash, and rows alike in both are kept together.

Defined cases: a null, empty or white-space text has no n-grams and log-weight 0; repeated
rows draw the same noise; a null id hashes as a value of its own; with no labelled good
document to fit or to hold out every row is kept; an empty table stays empty; extra columns
are kept by ``keep_documents`` and ignored by ``select_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latora.llm.common import checkpointed, map_batches, row_slices, utf8

BUCKETS = 1 << 14
TARGET_SAMPLE = 20_000
SMOOTHING = 1.0
#: The most that one n-gram counts for, in nats: buckets are shared, by chance, with rare text.
MOST = 2.0
SEED = 17
TEMPER = 10.0
MISSED = 0.002
#: The least variance per n-gram, for held-out documents that are all alike.
LEAST = 1e-4
DIGIT = 12


def buckets(text: bytes) -> np.ndarray:
    """Hash buckets of the words and word pairs of a text (A-Z lower-cased, split at white space)."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int64)


def target_ids(labels: DataFrame, sample: int = TARGET_SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most ``sample`` ids of good documents, in hash order, and whether each is held out."""
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("__target_id")).filter("__target_id IS NOT NULL").distinct()
    first = good.orderBy(F.xxhash64("__target_id", F.lit(SEED)), "__target_id").limit(sample)
    return first.withColumn("__held_out", F.pmod(F.xxhash64("__target_id", F.lit(SEED + 1)), F.lit(2)) == 1)


def _with_target(docs: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """The documents with the target columns, null but for the sample; its size bounds the broadcast."""
    return docs.join(F.broadcast(targets), F.col(id_col).cast("long") == F.col("__target_id"), "left")


def bucket_counts(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """N-grams per bucket of the raw corpus and of the target, in one reading of all documents."""
    marked = _with_target(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), targets, "id")
    marked = marked.select("text", F.coalesce(~F.col("__held_out"), F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in row_slices(batches):
            for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = buckets(utf8(text))
                np.add.at(raw, found, 1)
                if good:
                    np.add.at(target, found, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    sums = map_batches(marked, run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the ratio of smoothed bucket probabilities, target over raw, freed of small-sample bias.

    Without that, documents outside of the target sample would look unlike it, the more so the
    fewer labels there are.
    """
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    ratio = share(target) - share(raw)
    # the log of a small count lies below the log of its mean, by half its relative variance
    ratio += 0.5 / (target + SMOOTHING) - 0.5 / (raw + SMOOTHING)
    return np.clip(ratio, -MOST, MOST)


def gumbel(*by: Column | str, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


class Calibration(NamedTuple):
    """Mean of the log-ratio per n-gram, and its variance per n-gram and per square of their number."""

    mean: float
    per_gram: float
    squared: float

    def weight(self) -> Column:
        """The tempered log-weight, of columns log_ratio and n_grams; 0 without n-grams."""
        n = F.col("n_grams")
        z = (F.col("log_ratio") - self.mean * n) / F.sqrt(self.per_gram * n + self.squared * n * n)
        return F.when(n > 0, TEMPER * z).otherwise(0.0)


def calibration(held: DataFrame) -> Calibration:
    """Fitted by moments: the squares of centred log-ratios over n, and over n squared, have means linear in a and b."""
    s, n = F.col("log_ratio"), F.col("n_grams")
    r = held.filter("n_grams > 0").agg(
        F.count("*").alias("m"), F.sum(s).alias("s"), F.sum(n).alias("n"), F.sum(s / n).alias("s1"), F.sum(1 / n).alias("n1"),
        F.sum(s * s / n).alias("q1"), F.sum(s * s / (n * n)).alias("q2"),
    ).first()
    if not r.m:
        return Calibration(0.0, 1.0, 0.0)
    mean = r.s / r.n
    over_n = (r.q1 - 2 * mean * r.s + mean * mean * r.n) / r.m
    over_square = (r.q2 - 2 * mean * r.s1 + mean * mean * r.m) / r.m
    length, inverse = r.n / r.m, r.n1 / r.m
    spread = length * inverse - 1  # 0 if all are of one length
    squared = (over_n * inverse - over_square) / spread if spread > 1e-9 else 0.0
    squared = min(max(squared, 0.0), max(over_n, 0.0) / length)
    return Calibration(mean, max(over_n - squared * length, LEAST), squared)


def with_scores(docs: DataFrame, ratio: Broadcast, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(doc_id, text_hash, log_ratio, n_grams) of every row; and the row itself on demand."""
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")]
    if keep_row:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1024):
            found = (buckets(utf8(t)) for t in part.column("text").to_pylist())
            sums = [(float(ratio.value[b].sum()), float(len(b))) for b in found]
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array([x[k] for x in sums], pa.float64()) for k in (0, 1))], names=[*kept, "log_ratio", "n_grams"])

    schema = "doc_id long, text_hash long" + (f", row {rows.schema['row'].dataType.simpleString()}" if keep_row else "") + ", log_ratio double, n_grams double"
    return map_batches(rows, run, schema)


def weighed(scored: DataFrame, fit: Calibration) -> DataFrame:
    """With log_weight, and the key that the Gumbel noise makes of it."""
    return scored.withColumn("log_weight", fit.weight()).withColumn("key", F.col("log_weight") + gumbel("doc_id"))


def _ordinal(x: Column) -> Column:
    """A long of the same order as a double: steps of 2^-20, which is finer than any weight matters."""
    return F.round(x * (1 << 20)).cast("long")


def _kth_largest(rows: DataFrame, column: Column, k: int) -> tuple[int, int]:
    """The k-th largest value of a long column, and how many rows lie above it.

    Counts by leading bits, at most 2^DIGIT a round, tell which range holds the value.
    """
    above, at = 0, None
    for shift in (*range(64 - DIGIT, 0, -DIGIT), 0):
        prefix = F.shiftright(column, shift)
        for r in sorted(rows.groupBy(prefix.alias("prefix")).count().collect(), key=lambda r: -r["prefix"]):
            if above + r["count"] >= k:
                at = r["prefix"]
                break
            above += r["count"]
        rows = rows.filter(prefix == at)
    return at, above


def top_k_cut(scored: DataFrame, k: int, key: str = "key", tie: str = "text_hash") -> tuple[int, int]:
    """The smallest (ordinal of key, tie) of the top k, exactly."""
    at, above = _kth_largest(scored, _ordinal(F.col(key)), k)
    tie_at, _ = _kth_largest(scored.filter(_ordinal(F.col(key)) == at), F.col(tie), k - above)
    return at, tie_at


def _above(at: int, tie_at: int) -> Column:
    ordinal = _ordinal(F.col("key"))
    return (ordinal > at) | ((ordinal == at) & (F.col("text_hash") >= tie_at))


def _cut(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[Broadcast, Calibration, DataFrame, Column]:
    """The fitted ratio and its calibration, the weights of every row, and the condition of the top-k."""
    targets = checkpointed(target_ids(labels, sample))
    raw, target = bucket_counts(docs, targets, id_col, text_col)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(raw, target))
    scored = checkpointed(_with_target(with_scores(docs, ratio, id_col, text_col), targets, "doc_id").drop("__target_id"))
    fit = calibration(scored.filter("__held_out"))
    scored = weighed(scored, fit)
    least = scored.filter("__held_out").agg(F.percentile("log_weight", F.lit(MISSED))).first()[0]
    if least is None or not ratio.value.any():
        return ratio, fit, scored, F.lit(True)
    least = min(least, TEMPER * NormalDist().inv_cdf(MISSED))
    sums = scored.agg(F.count("*").alias("n"), F.count_if(F.col("log_weight") >= least).alias("k")).first()
    if 1 <= sums.k < sums.n:
        return ratio, fit, scored, _above(*top_k_cut(scored, sums.k))
    return ratio, fit, scored, F.lit(sums.k >= sums.n)


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TARGET_SAMPLE) -> DataFrame:
    """(doc_id, text_hash, log_ratio, log_weight, key) of every row, and ``kept``: whether it is in the Gumbel top-k."""
    _, _, scored, top = _cut(docs, labels, id_col, text_col, sample)
    return scored.select("doc_id", "text_hash", "log_ratio", "log_weight", "key", top.alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TARGET_SAMPLE) -> DataFrame:
    """The documents in the top-k, all columns kept.

    Texts are weighed again as they pass, which costs one more reading and no shuffle of texts.
    """
    ratio, fit, _, top = _cut(docs, labels, id_col, text_col, sample)
    kept = weighed(with_scores(docs, ratio, id_col, text_col, keep_row=True), fit).filter(top)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))

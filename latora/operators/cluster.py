"""k-means over distributed rows, and agreement of partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latora.functions.ranking import durable
from latora.operators.similarity import _vectors

SILHOUETTE_SAMPLE = 2000


@dataclass(frozen=True)
class ClusterResult:
    centroids: np.ndarray
    inertia: float
    n_iter: int
    converged: bool

    def assign(self, points: DataFrame, id_col: str = "song_id", features: str = "features") -> DataFrame:
        """(id, cluster, d2): the nearest centroid, of equals the first."""
        return assign(points, self.centroids, id_col, features)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)[None, :])


def assign(points: DataFrame, centroids: np.ndarray, id_col: str = "song_id", features: str = "features") -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_vectors(batch.column(1)), shared.value)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], names=[id_col, "cluster", "d2"])

    return points.select(F.col(id_col).cast("long"), features).mapInArrow(run, f"{id_col} long, cluster int, d2 double")


def lloyd_step(points: DataFrame, centroids: np.ndarray, features: str = "features") -> tuple[np.ndarray, float]:
    """New centroids and the inertia to the old ones."""
    return lloyd_steps(points, [centroids], features)[0]


def lloyd_steps(points: DataFrame, starts: Sequence[np.ndarray], features: str = "features") -> list[tuple[np.ndarray, float]]:
    """One step of several restarts in one pass. Tasks hand on sums of k clusters, and their farthest point, for each."""
    k, width = starts[0].shape
    shared = points.sparkSession.sparkContext.broadcast([np.asarray(c, float) for c in starts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value)
        sums, count, inertia = np.zeros((n, k, width)), np.zeros((n, k), np.int64), np.zeros((n, k))
        far, far_at = np.full(n, -1.0), np.zeros((n, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0))
            for r, centroids in enumerate(shared.value):
                d = _distances(x, centroids)
                best = d.argmin(axis=1)
                least = d[np.arange(len(d)), best]
                np.add.at(sums[r], best, x)
                np.add.at(count[r], best, 1)
                np.add.at(inertia[r], best, least)
                if least.max() > far[r]:
                    far[r], far_at[r] = float(least.max()), x[least.argmax()]
        restart, cluster = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        vectors = lambda v: pa.array(list(v), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(restart, pa.int32()), pa.array(cluster, pa.int32()), vectors(sums.reshape(-1, width)), pa.array(count.ravel()), pa.array(inertia.ravel()), pa.array(np.repeat(far, k)), vectors(np.repeat(far_at, k, axis=0))],
            names=["restart", "cluster", "sums", "n", "inertia", "far", "far_at"],
        )

    parts = points.select(features).mapInArrow(run, "restart int, cluster int, sums array<double>, n long, inertia double, far double, far_at array<double>")
    total = F.array(*(F.sum(F.col("sums")[i]) for i in range(width)))
    rows = parts.groupBy("restart", "cluster").agg(total.alias("sums"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.max_by("far_at", "far").alias("far_at")).collect()
    out = [(np.array(c, float), 0.0) for c in starts]
    for r in sorted(rows, key=lambda r: (r.restart, r.cluster)):
        new, inertia = out[r.restart]
        # a cluster without points starts again at the point farthest from its centroid
        new[r.cluster] = np.array(r.sums) / r.n if r.n else np.array(r.far_at)
        out[r.restart] = (new, inertia + r.inertia)
    return out


def kmeans(points: DataFrame, k: int, n_restarts: int = 10, max_iter: int = 300, tol: float = 1e-6, seed: int = 0, features: str = "features", id_col: str = "song_id", single_step: bool = False) -> ClusterResult:
    """Lloyd's algorithm from k-means++ seeds; of all restarts that of the least inertia.

    Seeds are drawn from all rows. All restarts step in the same pass over the points, which are
    kept durably, so that a pass doesn't compute them anew. ``single_step`` stops each restart
    after one step, for comparison with figures that were made so.
    """
    points = durable(points.select(F.col(id_col).cast("long").alias("id"), F.col(features).alias("x")))
    n = points.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be in 1..{n}, got {k}")
    centroids = _plus_plus(points, k, max(1, n_restarts), seed)
    before, steps, done = [math.inf] * len(centroids), [0] * len(centroids), [False] * len(centroids)
    for step in range(1, max_iter + 1):
        moving = [r for r, d in enumerate(done) if not d]
        if not moving:
            break
        for r, (new, inertia) in zip(moving, lloyd_steps(points, [centroids[r] for r in moving], "x")):
            centroids[r], steps[r] = new, step
            done[r] = single_step or (math.isfinite(before[r]) and before[r] - inertia <= tol * before[r])
            before[r] = inertia
    final = [inertia for _, inertia in lloyd_steps(points, centroids, "x")]
    best = int(np.argmin(final))
    return ClusterResult(centroids[best], final[best], steps[best], done[best])


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) that ids and salt alone decide, so that a task run again draws the same."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)
        for s in salt:
            x = (x ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _plus_plus(points: DataFrame, k: int, n: int, seed: int) -> list[np.ndarray]:
    """Centroids of ``n`` restarts, drawn from all rows in proportion to squared distance, a pass for each of the k.

    The row of the least exponential noise over weight is such a draw, and a minimum needs no
    sum of weights beforehand. Where all distances are zero the lowest id is taken.
    """
    chosen: list[list] = [[] for _ in range(n)]
    for step in range(k):
        shared = points.sparkSession.sparkContext.broadcast([np.array(c, float) for c in chosen])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), _vectors(batch.column(1))
                rows = []
                for r, centroids in enumerate(shared.value):
                    d = _distances(x, centroids).min(axis=1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        key = np.where(d > 0, -np.log(_uniform(ids, seed, r, step)) / d, np.inf)
                    at = np.lexsort((ids, key))[0]
                    rows.append((r, float(key[at]), int(ids[at]), x[at].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["restart", "key", "id", "x"])

        drawn = points.mapInArrow(run, "restart int, key double, id long, x array<double>")
        for row in drawn.groupBy("restart").agg(F.min_by("x", F.struct("key", "id")).alias("x")).collect():
            chosen[row.restart].append(row.x)
    return [np.array(c, float) for c in chosen]


def silhouette(points: DataFrame, id_col: str = "song_id", label: str = "cluster", features: str = "features", max_samples: int = SILHOUETTE_SAMPLE, seed: int = 0) -> float:
    """Mean silhouette by Euclidean distance, exact on at most ``max_samples`` rows in hash order.

    The sample is the definition of this score; one point alone in a cluster scores 0, and
    so does a single cluster.
    """
    rows = points.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(max_samples).select(features, label).collect()
    if not rows:
        return 0.0
    x = np.array([r[0] for r in rows], float)
    names, which = np.unique([str(r[1]) for r in rows], return_inverse=True)
    if len(names) < 2:
        return 0.0
    d = np.sqrt(_distances(x, x))
    np.fill_diagonal(d, 0.0)
    count = np.bincount(which)
    to = np.stack([d[:, which == c].sum(axis=1) for c in range(len(names))], axis=1)
    own = count[which]
    inside = to[np.arange(len(x)), which] / np.maximum(own - 1, 1)
    other = to / count
    other[np.arange(len(x)), which] = np.inf
    outside = other.min(axis=1)
    scale = np.maximum(inside, outside)
    return float(np.where((own > 1) & (scale > 0), (outside - inside) / np.where(scale > 0, scale, 1), 0.0).mean())


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def confusion_table(pairs: DataFrame, cluster: str, label: str) -> DataFrame:
    """A row for each cluster, a column for each class."""
    return pairs.groupBy(cluster).pivot(label).count().fillna(0)


def row_shares(pairs: DataFrame, cluster: str, label: str) -> DataFrame:
    """Shares of classes within clusters, with the dominant class of each."""
    counts = contingency(pairs, cluster, label)
    whole = Window.partitionBy(cluster)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("dominant", F.max_by(label, F.struct("n", label)).over(whole))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, classes of each, adjusted Rand index, normalised mutual information and purity of a by b.

    One cube gives the joint counts and both margins; the rest is sums over them.
    """
    cube = pairs.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    pair = F.col("n") * (F.col("n") - 1) / 2.0
    joint, rows, columns, whole = (F.col("ga") == 0) & (F.col("gb") == 0), (F.col("ga") == 0) & (F.col("gb") == 1), (F.col("ga") == 1) & (F.col("gb") == 0), (F.col("ga") == 1) & (F.col("gb") == 1)
    plogn = F.col("n") * F.log(F.col("n"))
    part = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    s = cube.agg(
        F.coalesce(F.max(F.when(whole, F.col("n"))), F.lit(0)).alias("n"), F.count_if(rows).alias("n_a"), F.count_if(columns).alias("n_b"),
        part(joint, pair).alias("both"), part(rows, pair).alias("in_a"), part(columns, pair).alias("in_b"),
        part(joint, plogn).alias("l_ab"), part(rows, plogn).alias("l_a"), part(columns, plogn).alias("l_b"),
    )
    best = cube.filter(joint).groupBy(a).agg(F.max("n").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("best"))
    n = F.col("n")
    all_pairs = n * (n - 1) / 2.0
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), all_pairs)
    most = (F.col("in_a") + F.col("in_b")) / 2
    h_a, h_b = F.log(n) - F.col("l_a") / n, F.log(n) - F.col("l_b") / n
    mutual = F.log(n) + (F.col("l_ab") - F.col("l_a") - F.col("l_b")) / n
    mean = (h_a + h_b) / 2
    return s.crossJoin(best).select(
        "n", "n_a", "n_b",
        F.when(F.abs(most - expected) > 1e-12, (F.col("both") - expected) / (most - expected)).otherwise(0.0).alias("adjusted_rand"),
        F.when(mean > 1e-15, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mutual / mean))).otherwise(0.0).alias("nmi"),
        F.coalesce(F.try_divide("best", "n"), F.lit(0.0)).alias("purity"),
    )


#: Bands of the adjusted Rand index: chance level, faint, moderate and good agreement.
AGREEMENT_BANDS = ((0.1, "no agreement"), (0.3, "faint agreement"), (0.6, "moderate agreement"), (math.inf, "good agreement"))


def verdict(ari: float) -> str:
    """A reading of the adjusted Rand index in words."""
    if math.isnan(ari):
        raise ValueError("ari must be a number")
    words = next(words for limit, words in AGREEMENT_BANDS if ari < limit)
    return f"clusters and labels: {words} (adjusted Rand index {ari:.2f})"


def compare_to_labels(points: DataFrame, label: str, k: int | None = None, n_restarts: int = 10, seed: int = 0, features: str = "features", id_col: str = "song_id", single_step: bool = False) -> tuple[ClusterResult, dict]:
    """Clusters against a label column: agreement, silhouette and a verdict."""
    k = k or points.select(label).distinct().count()
    result = kmeans(points, k, n_restarts, seed=seed, features=features, id_col=id_col, single_step=single_step)
    found = result.assign(points, id_col, features).join(points.select(id_col, features, label), id_col)
    row = agreement(found, "cluster", label).first()
    out = {"k": k, "adjusted_rand_index": row.adjusted_rand, "normalized_mutual_information": row.nmi, "purity": row.purity, "silhouette": silhouette(found, id_col, "cluster", features, seed=seed), "n_reference_classes": row.n_b}
    return result, out | {"verdict": verdict(row.adjusted_rand)}

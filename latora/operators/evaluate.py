"""Offline evaluation: held-out groups, baseline rankers, comparison and tests.

All queries of a system are ranked at once: the seeds of every query (bounded by
``max_groups`` times ``seed_size``) are multiplied with batches of the catalogue.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latora.functions.ranking import durable, ranked_within, top_k_by
from latora.operators import metrics
from latora.operators.similarity import _best, _vectors, unit_rows

UNKNOWN_LABELS = ("", "unknown", "nan")
METRICS = ("hit_rate", "precision", "recall", "mrr", "ndcg", "diversity", "novelty", "entropy")


def drawn_by(col: str, seed: int) -> Column:
    """A draw's order, which any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(col).cast("string")))


def build_groups(catalog: DataFrame, label: str = "artist_names", seed_size: int = 3, min_group_size: int = 6, max_groups: int = 400, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(seeds, relevant), both (query_id, song_id): some members of each group, and the others.

    Which groups (if there are too many) and which members are drawn by hash order.
    """
    labelled = catalog.select("song_id", F.lower(F.trim(F.col(label).cast("string"))).alias("key")).filter(F.col("key").isNotNull() & ~F.col("key").isin(*UNKNOWN_LABELS))
    groups = labelled.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_group_size)
    drawn = groups.orderBy(drawn_by("key", seed), "key").limit(max_groups)
    # at most max_groups rows
    named = F.broadcast(drawn.withColumn("query_id", F.row_number().over(Window.orderBy("key")).cast("long") - 1))
    placed = labelled.join(named, "key").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(drawn_by("song_id", seed), "song_id")))
    is_seed = F.col("r") <= F.least(F.lit(seed_size), F.col("n") - 1)
    return placed.filter(is_seed).select("query_id", "song_id"), placed.filter(~is_seed).select("query_id", "song_id")


class Ranker(ABC):
    """Ranks songs for all queries at once: (query_id, pos, song_id, score), without the excluded."""

    name = "ranker"

    @abstractmethod
    def rank(self, seeds: DataFrame, n: int) -> DataFrame: ...


class RandomRanker(Ranker):
    name = "random"

    def __init__(self, catalog: DataFrame, seed: int = 0):
        self.catalog, self.seed = catalog, seed

    def rank(self, seeds: DataFrame, n: int) -> DataFrame:
        return _rank_all(self.catalog, seeds, n, lambda q, ids, vectors, seed=self.seed: _noise(q, ids, seed), None)


class PopularityRanker(Ranker):
    """The same order for every query, without its seeds."""

    name = "popularity"

    def __init__(self, catalog: DataFrame):
        self.catalog = catalog

    def rank(self, seeds: DataFrame, n: int) -> DataFrame:
        most = seeds.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        top = self.catalog.select("song_id", F.col("pop").alias("score")).orderBy(F.desc("score"), "song_id").limit(n + most)
        pairs = seeds.select("query_id").distinct().crossJoin(F.broadcast(top))  # n + seeds rows, for each query
        return top_k_by(pairs.join(seeds, ["query_id", "song_id"], "left_anti"), ["query_id"], n, F.desc("score"), "song_id").select("query_id", "pos", "song_id", "score")


class VectorRanker(Ranker):
    """Cosine to the seeds, by maximum, mean or Borda points, on any vector column."""

    def __init__(self, name: str, vectors: DataFrame, aggregation: str = "max", vector_col: str = "features"):
        if aggregation not in ("max", "mean", "borda"):
            raise ValueError(f"unknown aggregation {aggregation!r}")
        self.name, self.vectors, self.aggregation, self.vector_col = name, vectors.select("song_id", F.col(vector_col).alias("features")), aggregation, vector_col

    def rank(self, seeds: DataFrame, n: int) -> DataFrame:
        if self.aggregation == "borda":
            return self._borda(seeds, n)
        return _rank_all(self.vectors, seeds, n, None, self.aggregation)

    def _borda(self, seeds: DataFrame, n: int) -> DataFrame:
        """Points need every song's place for each seed, so all scores are laid out and ranked."""
        size = self.vectors.count()
        each = seeds.withColumn("seed_row", F.row_number().over(Window.orderBy("query_id", "song_id")).cast("long"))
        alone = each.select(F.col("seed_row").alias("query_id"), "song_id")
        ranked = _rank_all(self.vectors, alone, size, None, "max", keep_seeds=True)
        points = ranked.withColumnRenamed("query_id", "seed_row").join(F.broadcast(each.select("seed_row", "query_id")), "seed_row").groupBy("query_id", "song_id").agg(F.sum(size + 1 - F.col("pos")).cast("double").alias("score"))
        return top_k_by(points.join(seeds, ["query_id", "song_id"], "left_anti"), ["query_id"], n, F.desc("score"), "song_id").select("query_id", "pos", "song_id", "score")


PRIME = 2**31 - 1


def _noise(queries: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Squares and products modulo a prime: alike in any engine that has 64-bit integers."""
    x = ((ids % PRIME + 1) * 48271 % PRIME)[None, :]
    y = ((queries % PRIME + seed + 1) * 69621 % PRIME)[:, None]
    w = (x + y) % PRIME
    w = w * w % PRIME
    return (w * (x * y % PRIME) % PRIME).astype(np.float64)


def _rank_all(vectors: DataFrame, seeds: DataFrame, n: int, score, aggregation: str | None, keep_seeds: bool = False) -> DataFrame:
    """Top n for every query; ``score`` or the aggregated cosine to the query's seeds."""
    rows = seeds.select("query_id", "song_id")
    pairs = [(r.query_id, r.song_id) for r in rows.orderBy("query_id", "song_id").collect()]  # max_groups x seed_size
    queries = np.array(sorted({q for q, _ in pairs}), np.int64)
    where = {int(q): k for k, q in enumerate(queries)}
    owner = np.array([where[q] for q, _ in pairs], np.int64)
    seed_ids = np.array([s for _, s in pairs], np.int64)
    seed_units = None
    if score is None:
        found = {r.song_id: r.features for r in vectors.filter(F.col("song_id").isin(sorted({s for _, s in pairs}))).collect()}
        seed_units = unit_rows(np.array([found[s] for _, s in pairs], float))
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(owner)]]))
    shared = vectors.sparkSession.sparkContext.broadcast((queries, owner, seed_ids, seed_units, first, size))
    columns = ["song_id"] if score is not None else ["song_id", "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, own, sid, units, begin, count = shared.value
        for batch in batches:
            if not batch.num_rows or not len(qs):
                continue
            ids = batch.column(0).to_numpy()
            if score is not None:
                value = score(qs, ids, None)
            else:
                sims = np.clip(units @ unit_rows(_vectors(batch.column(1))).T, -1, 1)
                value = np.maximum.reduceat(sims, begin, axis=0) if aggregation == "max" else np.add.reduceat(sims, begin, axis=0) / count[:, None]
            if not keep_seeds:
                s, c = np.nonzero(sid[:, None] == ids[None, :])
                value[own[s], c] = -np.inf
            order = np.argsort(ids, kind="stable")
            row, column = _best(value[:, order], n)
            yield pa.RecordBatch.from_arrays([pa.array(qs[row]), pa.array(ids[order][column]), pa.array(value[:, order][row, column])], names=["query_id", "song_id", "score"])

    scored = vectors.select(F.col("song_id").cast("long"), *columns[1:]).mapInArrow(run, "query_id long, song_id long, score double")
    if keep_seeds:
        return ranked_within(scored, "query_id", n, F.desc("score"), F.col("song_id")).select("query_id", "pos", "song_id", "score")
    return top_k_by(scored, ["query_id"], n, F.desc("score"), "song_id").select("query_id", "pos", "song_id", "score")


def standard_rankers(catalog: DataFrame, scaled: DataFrame, latent: dict[str, DataFrame], seed: int = 0) -> list[Ranker]:
    """Random, popularity, cosine without a factorisation, and one ranker for each latent space."""
    return [RandomRanker(catalog, seed), PopularityRanker(catalog), VectorRanker("raw_cosine", scaled), *(VectorRanker(name, df) for name, df in latent.items())]


def evaluate(ranker: Ranker, seeds: DataFrame, relevant: DataFrame, catalog: DataFrame, shared: DataFrame, width: int, k: int = 10) -> DataFrame:
    """(system, query_id, metric, value) of one system; coverage has query_id -1."""
    return compare([ranker], seeds, relevant, catalog, shared, width, k)


def compare(rankers: Sequence[Ranker], seeds: DataFrame, relevant: DataFrame, catalog: DataFrame, shared: DataFrame, width: int, k: int = 10) -> DataFrame:
    """The long table of all systems. Their rankings are stacked, so that each metric is computed once for all."""
    ranked = None
    for ranker in rankers:
        part = ranker.rank(seeds, k).select(F.lit(ranker.name).alias("system"), "query_id", "pos", "song_id")
        ranked = part if ranked is None else ranked.unionByName(part)
    ranked = durable(ranked)
    systems = F.explode(F.array(*(F.lit(r.name) for r in rankers)))
    both = lambda df: df.withColumn("query_id", F.struct("system", "query_id"))
    lists = both(ranked)
    base = metrics.ranking_metrics(lists, both(relevant.withColumn("system", systems)), k)
    wide = base.join(metrics.intra_list_diversity(lists, shared, width, k), "query_id", "left").join(metrics.novelty(lists, catalog, k), "query_id", "left").join(metrics.label_entropy(lists, catalog, k=k), "query_id", "left").fillna(0.0)
    long = wide.select("query_id.*", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))).alias("x")).select("system", "query_id", "x.metric", "x.value")
    n = catalog.count()
    shown = ranked.filter(F.col("pos") <= k).groupBy("system").agg((F.countDistinct("song_id") / max(1, n)).alias("value"))
    return long.unionByName(shown.select("system", F.lit(-1).cast("long").alias("query_id"), F.lit("coverage").alias("metric"), "value"))


def summary(scores: DataFrame) -> DataFrame:
    """Means of each system, the best by NDCG first."""
    return scores.groupBy("system").pivot("metric", [*METRICS, "coverage"]).agg(F.avg("value")).orderBy(F.desc("ndcg"), "system")


def bootstrap_ci(scores: DataFrame, confidence: float = 0.95, n_resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(system, metric, mean, low, high): percentile bootstrap of the mean over queries."""

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("query_id").value.to_numpy()
        low, high = _interval(_resampled(values, n_resamples, seed), confidence) if len(values) > 1 else (values[0], values[0])
        return pd.DataFrame([(rows.system.iloc[0], rows.metric.iloc[0], values.mean(), low, high)], columns=["system", "metric", "mean", "low", "high"])

    return scores.filter("query_id >= 0").groupBy("system", "metric").applyInPandas(interval, "system string, metric string, mean double, low double, high double")


def _resampled(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Means of resamples, in blocks of bounded size."""
    rng = np.random.default_rng(seed)
    block = max(1, min(n, (1 << 22) // max(1, len(values))))
    return np.concatenate([values[rng.integers(0, len(values), (min(block, n - at), len(values)))].mean(axis=1) for at in range(0, n, block)])


def _interval(means: np.ndarray, confidence: float) -> tuple[float, float]:
    tail = 100 * (1 - confidence) / 2
    return float(np.percentile(means, tail)), float(np.percentile(means, 100 - tail))


def paired_bootstrap(scores: DataFrame, baseline: str = "raw_cosine", metric: str = "ndcg", confidence: float = 0.95, n_resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Each system against the baseline: difference, interval and two-sided p by centred resamples."""
    own = scores.filter((F.col("metric") == metric) & (F.col("query_id") >= 0))
    base = own.filter(F.col("system") == baseline).select("query_id", F.col("value").alias("other"))
    paired = own.filter(F.col("system") != baseline).join(base, "query_id")

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query_id")
        gap = (rows.value - rows.other).to_numpy()
        observed = gap.mean()
        means = _resampled(gap, n_resamples, seed)
        low, high = _interval(means, confidence)
        p = max(1 / n_resamples, float((np.abs(means - observed) >= abs(observed) - 1e-15).mean())) if gap.any() else 1.0
        return pd.DataFrame([(rows.system.iloc[0], rows.value.mean(), rows.other.mean(), observed, low, high, p)], columns=["system", "mean", "baseline_mean", "difference", "low", "high", "p"])

    return paired.groupBy("system").applyInPandas(test, "system string, mean double, baseline_mean double, difference double, low double, high double, p double")


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05, by: str = "system") -> DataFrame:
    """Step-down adjusted p-values of a family (a handful of rows), and which stay below ``alpha``."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must be in (0, 1), got {alpha}")
    order = Window.orderBy(p, by)
    family = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (family - F.row_number().over(order) + 1) * F.col(p))
    out = tests.withColumn("_step", step).withColumn("adjusted_p", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    return out.withColumn("significant", F.col("adjusted_p") < alpha)

"""Small reports over a catalogue and a model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latora.operators.model import LatentModel
from latora.operators.rank import by_elbow, by_gavish_donoho, by_variance


def variance_shares(catalog: DataFrame, feature_names: Sequence[str], features: str = "features") -> DataFrame:
    """(feature, variance, share): population variance of each raw feature and its share of all."""
    row = catalog.agg(*(F.var_pop(F.col(features)[k]).alias(n) for k, n in enumerate(feature_names)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("variance")) for n in feature_names))).alias("x")).select("x.*")
    whole = row.select(sum((F.col(n) for n in feature_names[1:]), F.col(feature_names[0])).alias("whole"))
    return long.crossJoin(whole).select("feature", "variance", F.try_divide("variance", "whole").alias("share"))  # one row


def scree(spark: SparkSession, sigma: Sequence[float]) -> DataFrame:
    """(component, sigma, share, cumulative)."""
    energy = np.asarray(sigma, float) ** 2
    share = energy / energy.sum() if energy.sum() else np.zeros_like(energy)
    rows = [(k + 1, float(s), float(x), float(c)) for k, (s, x, c) in enumerate(zip(sigma, share, np.cumsum(share)))]
    return spark.createDataFrame(rows, "component int, sigma double, share double, cumulative double")


def three_ranks(sigma: Sequence[float], n_rows: int, n_cols: int, threshold: float = 0.9) -> dict[str, int]:
    return {"variance": by_variance(sigma, threshold), "elbow": by_elbow(sigma), "gavish_donoho": by_gavish_donoho(sigma, n_rows, n_cols)}


def loadings(spark: SparkSession, model: LatentModel) -> DataFrame:
    """(component, place, feature, weight), by size of weight within each component."""
    rows = [(c, p + 1, name, float(w)) for c in range(1, model.k + 1) for p, (name, w) in enumerate(model.loadings(c))]
    return spark.createDataFrame(rows, "component int, place int, feature string, weight double")


def feature_summary(catalog: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """(feature, n, mean, sd, min, q25, median, q75, max)."""
    long = catalog.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col("features")[k].alias("v")) for k, n in enumerate(feature_names)))).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max("v").alias("max"))


def best_reduced(summary: DataFrame, full: str, prefix: str = "svd_k") -> dict:
    """The best truncated system by NDCG, and how far the full-rank one lies from raw cosine."""
    ndcg = {r.system: r.ndcg for r in summary.select("system", "ndcg").collect()}  # a row for each system
    reduced = {s: v for s, v in ndcg.items() if s.startswith(prefix) and s != full}
    best = max(sorted(reduced), key=reduced.get) if reduced else None
    return {"best": best, "ndcg": reduced.get(best), "full_rank_gap": abs(ndcg[full] - ndcg["raw_cosine"]) if full in ndcg and "raw_cosine" in ndcg else None}

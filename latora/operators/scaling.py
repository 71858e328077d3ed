"""Feature scaling: fitted in one aggregation, applied as a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latora.functions.ranking import quantiles

METHODS = ("zscore", "robust", "none")
CONSTANT = 1e-12


@dataclass(frozen=True)
class Scaler:
    """Centre and scale of each feature."""

    center: tuple[float, ...]
    scale: tuple[float, ...]
    method: str
    feature_names: tuple[str, ...]

    def transform(self, features: Column) -> Column:
        return F.array(*((features[k] - F.lit(c)) / F.lit(s) for k, (c, s) in enumerate(zip(self.center, self.scale))))

    def inverse_transform(self, scaled: Column) -> Column:
        return F.array(*(scaled[k] * F.lit(s) + F.lit(c) for k, (c, s) in enumerate(zip(self.center, self.scale))))


def fit_scaler(df: DataFrame, feature_names: Sequence[str], method: str = "zscore", features: str = "features") -> Scaler:
    """Population mean and deviation, exact median and quartile range, or neither."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling {method!r}; expected one of {METHODS}")
    x = [F.col(features)[k] for k in range(len(feature_names))]
    stats = [F.count("*").alias("n"), F.count_if(F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).alias("bad")]
    for k, c in enumerate(x):
        if method == "zscore":
            stats += [F.avg(c).alias(f"c{k}"), F.stddev_pop(c).alias(f"s{k}")]
    row = df.agg(*stats).first()
    if not row.n:
        raise ValueError("no rows to scale")
    if row.bad:
        raise ValueError("features must be finite")
    if method == "zscore":
        pairs = [(row[f"c{k}"], row[f"s{k}"]) for k in range(len(x))]
    elif method == "robust":
        found = quantiles(df, {f"q{k}": c for k, c in enumerate(x)}, (0.25, 0.5, 0.75))
        pairs = [(middle, high - low) for low, middle, high in (found[f"q{k}"] for k in range(len(x)))]
    else:
        pairs = [(0.0, 1.0)] * len(x)
    scale = tuple(1.0 if abs(s) < CONSTANT else float(s) for _, s in pairs)
    return Scaler(tuple(float(c) for c, _ in pairs), scale, method, tuple(feature_names))

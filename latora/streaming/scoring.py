"""Extension: scoring new items as they arrive, and a live count of titles.

A fitted model is a projection of literals, so the same expressions run on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.functions.text import normalize_title
from latora.functions.vectors import clip, dot, unit
from latora.operators.model import LatentModel


def score_stream(stream: DataFrame, model: LatentModel, query: Sequence[float], features: str = "features") -> DataFrame:
    """The stream with ``latent`` and its cosine to a latent query."""
    length = sum(x * x for x in query) ** 0.5
    direction = [x / length if length > 1e-12 else 0.0 for x in query]
    return stream.withColumn("latent", model.transform(F.col(features))).withColumn("score", clip(dot(unit(F.col("latent"), model.k), direction, model.k)))


def title_counts(stream: DataFrame, time: str = "ts", title: str = "track_name", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Appearances of each normalised title in time windows; late rows are waited for by the watermark."""
    at = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", window), normalize_title(title, any_script=False).alias("title")).agg(F.count("*").alias("n"))

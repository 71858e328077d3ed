"""A generated chart table with structure: artists of several genres, duplicates, and jitter.

Rows are made where they are needed, each from hashes of its own number and the seed, so a
retried or repartitioned task makes the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latora.sources.catalog import DEFAULT_FEATURES, ingest

GENRES = ("shoegaze", "cumbia", "drone", "ska", "fado", "grime", "polka", "gospel")
BOUNDS = {"loudness": (-60.0, 0.0), "tempo": (40.0, 220.0)}
#: A genre's mean lies in the middle ``REACH`` of a feature's range, and songs spread by ``SPREAD`` of the range.
REACH, SPREAD = 0.7, 0.07


_FIRST = "Silver Paper Hollow Velvet Distant Golden Broken Quiet Electric Northern Amber Winter".split()
_SECOND = "Rivers Letters Signal Garden Mirrors Harbour Motion Lanterns Static Horizon Orchard Parade".split()
#: An artist's own lean, in spreads of the genre, and the noise of a repeated row.
LEAN, JITTER = 0.5, 1e-4


def genre_profile(genre: int, feature: int) -> tuple[float, float]:
    """(mean, deviation) of a feature in a genre.

    Means follow an additive sequence with another irrational step for each feature, so genres
    are spread over the range of every feature and no two features rank them alike.
    """
    low, high = BOUNDS.get(DEFAULT_FEATURES[feature], (0.0, 1.0))
    place = (0.5 + (genre + 1) * math.sqrt(feature + 2 + (feature > 1) + 2 * (feature > 5))) % 1.0
    return low + (high - low) * ((1 - REACH) / 2 + REACH * place), (high - low) * SPREAD


def _uniform(seed: int, name: str, *by: Column | str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), *by), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _normal(seed: int, name: str, *by: Column | str) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, name + "a", *by))) * F.cos(2 * math.pi * _uniform(seed, name + "b", *by))


def _name(number: Column, first: list[str], second: list[str]) -> Column:
    """Unique: two words by the number's digits, and a count when they run out."""
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int"))
    round_ = F.floor(number / (len(first) * len(second)))
    words = F.concat_ws(" ", pick(first, number), pick(second, F.floor(number / len(first))))
    return F.when(round_ > 0, F.concat_ws(" ", words, round_.cast("string"))).otherwise(words)


def synthetic_frame(spark: SparkSession, n_songs: int = 3000, n_artists: int = 220, duplicate_rate: float = 0.45, seed: int = 20240) -> DataFrame:
    """Raw chart rows: each song once, and ``duplicate_rate`` of as many again with jitter."""
    if n_songs < 1 or n_artists < 1:
        raise ValueError("songs and artists are needed")
    extra = int(n_songs * duplicate_rate)
    rows = spark.range(n_songs + extra).withColumnRenamed("id", "row")
    again = F.col("row") >= n_songs
    song = F.when(again, F.pmod(F.xxhash64(F.lit(seed), F.lit("again"), "row"), F.lit(n_songs))).otherwise(F.col("row"))
    rows = rows.withColumn("song", song).withColumn("artist", F.pmod(F.xxhash64(F.lit(seed), F.lit("artist"), "song"), F.lit(n_artists)))
    rows = rows.withColumn("g", F.pmod("artist", F.lit(len(GENRES))).cast("int"))
    features = {}
    for k, name in enumerate(DEFAULT_FEATURES):
        profiles = [genre_profile(g, k) for g in range(len(GENRES))]
        mean, spread = (F.get(F.array(*(F.lit(p[n]) for p in profiles)), F.col("g")) for n in (0, 1))
        value = mean + spread * (LEAN * _normal(seed, f"lean {name}", "artist") + _normal(seed, name, "song"))
        low, high = BOUNDS.get(name, (0.0, 1.0))
        clipped = F.greatest(F.lit(low), F.least(F.lit(high), value))
        features[name] = F.when(F.col("row") >= n_songs, clipped + JITTER * _normal(seed, f"jitter {name}", "row")).otherwise(clipped)
    rows = rows.withColumns(features)
    # the least of four uniforms to the power 5/8 is near a Beta(1.6, 6) long tail
    popularity = 100 * F.pow(F.least(*(_uniform(seed, f"popularity {k}", "song") for k in range(4))), F.lit(0.625))
    genre = F.get(F.array(*map(F.lit, GENRES)), F.col("g"))
    return rows.select("row", _name(F.col("song"), _FIRST, _SECOND).alias("track_name"), F.concat(F.lit("The "), _name(F.col("artist"), _SECOND, _FIRST)).alias("artist_names"), genre.alias("genre"), popularity.alias("popularity"), *DEFAULT_FEATURES)


def synthetic_catalog(spark: SparkSession, n_songs: int = 3000, n_artists: int = 220, duplicate_rate: float = 0.45, seed: int = 20240) -> DataFrame:
    return ingest(synthetic_frame(spark, n_songs, n_artists, duplicate_rate, seed), any_script=False, order=["row"]).drop("row")

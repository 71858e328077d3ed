"""The catalogue: reading, cleaning, collapsing duplicates, popularity and lookups.

A catalogue is a DataFrame of song_id, track_name, artist_names, other columns, and
``features`` (ARRAY<DOUBLE>).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latora.functions.ranking import numbered
from latora.functions.text import artist_key, match_score, normalize_title

# The usual feature columns, and other names under which columns are accepted.
DEFAULT_FEATURES = ("danceability", "energy", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "loudness", "tempo")
COLUMN_NAMES = {
    "track_name": ("track", "song", "name", "title", "track_title"),
    "artist_names": ("artist", "artists", "artist_name", "performer"),
    "album_name": ("album",),
    "popularity_raw": ("streams",),
    "chart_weeks": ("weeks_on_chart",),
}
MATCH_THRESHOLD = 0.72


class CatalogError(ValueError):
    """A table that can't be read as a catalogue."""


def canonical_columns(df: DataFrame) -> DataFrame:
    """Headers stripped, lower-cased, with underscores, and under their usual names."""
    usual = {other: name for name, others in COLUMN_NAMES.items() for other in others}
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    names = [usual.get(n, n) for n in names]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise CatalogError(f"several columns stand for {twice}")
    return df.toDF(*names)


def number(col: Column) -> Column:
    """A double, or null where the value isn't a finite-looking number (NaN included)."""
    text = col.cast("string")
    value = F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; quoted fields may hold commas, doubled quotes and line breaks."""
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path)


def ingest(df: DataFrame, feature_names: Sequence[str] = DEFAULT_FEATURES, deduplicate: bool = True, any_script: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """A raw table as a catalogue.

    ``order`` names columns that give the order of first appearance; without it the order is
    that of reading.
    """
    df = canonical_columns(df)
    if "track_name" not in df.columns:
        raise CatalogError(f"no title column; expected track_name or one of {sorted(COLUMN_NAMES['track_name'])}")
    if "artist_names" not in df.columns:
        df = df.withColumn("artist_names", F.lit("Unknown"))
    missing = [c for c in feature_names if c not in df.columns]
    if missing:
        raise CatalogError(f"missing features {missing}; available: {sorted(df.columns)}")
    by = F.struct(*order) if order else F.monotonically_increasing_id()
    numeric = dict(df.dtypes)
    df = df.withColumn("_order", by).withColumns({c: number(F.col(c)) if numeric[c] != "double" else F.when(~F.isnan(c), F.col(c)) for c in feature_names})
    df = df.dropna(subset=list(feature_names))
    if deduplicate:
        df = collapse(df, feature_names, any_script)
    df = numbered(df, "_order", "song_id").drop("_order")
    return df.withColumn("features", F.array(*feature_names))


def collapse(df: DataFrame, feature_names: Sequence[str], any_script: bool = True) -> DataFrame:
    """One row for each (normalised title, artist): exact medians of features, first known metadata."""
    keyed = df.withColumns({"_title": normalize_title("track_name", any_script), "_artist": artist_key("artist_names")})
    aggregates = [F.median(c).alias(c) for c in feature_names]
    for c in df.columns:
        if c in feature_names or c == "_order":
            continue
        aggregates.append(F.min(c).alias(c) if c == "peak_rank" else F.expr(f"min_by(`{c}`, _order) FILTER (WHERE `{c}` IS NOT NULL)").alias(c))
    grouped = keyed.groupBy("_title", "_artist").agg(*aggregates, F.count("*").alias("chart_appearances"), F.min("_order").alias("_order"))
    return grouped.drop("_title", "_artist")


def with_popularity(catalog: DataFrame) -> DataFrame:
    """``pop`` in [0, 1]: the first usable of popularity, popularity_raw and chart_appearances; else 1."""
    values = {}
    for c, log in (("popularity", False), ("popularity_raw", True), ("chart_appearances", True)):
        if c in catalog.columns:
            v = F.coalesce(number(F.col(c)), F.lit(0.0))
            values[c] = F.log1p(F.greatest(v, F.lit(0.0))) if log else v
    if not values:
        return catalog.withColumn("pop", F.lit(1.0))
    least_and_most = (f(v).alias(f"{n}_{c}") for c, v in values.items() for n, f in (("low", F.min), ("high", F.max)))
    row = catalog.agg(*least_and_most, *(F.count(number(F.col(c))).alias(f"known_{c}") for c in values)).first()
    for c, v in values.items():
        low, high = row[f"low_{c}"], row[f"high_{c}"]
        if row[f"known_{c}"] and high > low:
            return catalog.withColumn("pop", (v - low) / (high - low))
    return catalog.withColumn("pop", F.lit(1.0))


def duplicates_removed(raw: DataFrame, catalog: DataFrame) -> int:
    """Rows of a raw table that its catalogue doesn't hold one for one: without usable features, or collapsed."""
    return raw.count() - catalog.count()


def lookup(catalog: DataFrame, song_ids: Sequence[int]) -> DataFrame:
    """The rows of some songs, by their ids; unknown ids give none."""
    return catalog.filter(F.col("song_id").isin([int(i) for i in song_ids]))


def describe(catalog: DataFrame) -> DataFrame:
    return catalog.select("song_id", F.concat_ws(" - ", "track_name", "artist_names").alias("description"))


def best_matches(catalog: DataFrame, queries: DataFrame, limit: int = 5, threshold: float = MATCH_THRESHOLD, any_script: bool = True) -> DataFrame:
    """Ranked fuzzy matches of a table (query_id, title, hint).

    A few queries are broadcast to the songs. More are joined by the class of their length,
    as titles of too unlike lengths don't match, in blocks of songs. Matches are ranked exact
    first, then by score, then by song_id.
    """
    q = queries.select("query_id", normalize_title("title", any_script).alias("q"), normalize_title("hint", any_script).alias("h")).filter("q <> ''")
    songs = catalog.select("song_id", "track_name", "artist_names", normalize_title("track_name", any_script).alias("t"), normalize_title("artist_names", any_script).alias("a")).filter("t <> ''")
    near = F.abs(F.length("q") - F.length("t")) <= F.greatest(F.length("q"), F.length("t")) * 0.5
    if queries_fit(queries):
        pairs = songs.join(F.broadcast(q), near)
    else:
        # the shorter is at least half the longer, so classes of doubling length differ by one at most
        blocks = -(-catalog.count() // SONG_BLOCK) or 1
        length_class = lambda c: F.floor(F.log2(F.length(c))).cast("int")
        songs = songs.withColumns({"_class": length_class("t"), "_block": F.pmod(F.xxhash64("song_id"), F.lit(blocks))})
        own = length_class("q")
        q = q.withColumn("_class", F.explode(F.array(own - 1, own, own + 1))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = songs.join(q, ["_class", "_block"]).filter(near).drop("_class", "_block")
    base = match_score(F.col("q"), F.col("t"))
    hinted = F.when((F.col("h") == "") | (F.col("artist_names") == ""), base).when(F.contains("a", "h"), F.least(F.lit(1.0), base + 0.15)).otherwise(base - 0.05)
    scored = pairs.withColumn("exact", F.col("q") == F.col("t")).withColumn("score", hinted).filter(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "song_id"))
    return scored.withColumn("pos", rank).filter(F.col("pos") <= limit).select("query_id", "pos", "song_id", "track_name", "artist_names", "score", "exact")


QUERY_LIMIT = 10_000
SONG_BLOCK = 100_000


def queries_fit(queries: DataFrame) -> bool:
    """Whether a table of queries is small enough to broadcast."""
    return queries.limit(QUERY_LIMIT + 1).count() <= QUERY_LIMIT


def split_queries(queries: DataFrame) -> DataFrame:
    """(query_id, title, hint) of texts "Title - Artist", cut at the last " - "."""
    cut = F.col("text").rlike("(?s) - ")
    return queries.select("query_id", F.when(cut, F.regexp_extract("text", "(?s)^(.*) - ", 1)).otherwise(F.col("text")).alias("title"), F.when(cut, F.substring_index("text", " - ", -1)).otherwise("").alias("hint"))


def find(catalog: DataFrame, queries: DataFrame, fuzzy: bool = True, limit: int = 5, any_script: bool = True) -> DataFrame:
    """Matches of (query_id, text): fuzzy, or equal in normalised title."""
    split = split_queries(queries)
    if fuzzy:
        return best_matches(catalog, split, limit, any_script=any_script)
    q = split.select("query_id", normalize_title("title", any_script).alias("t"), F.lower("hint").alias("h"))
    songs = catalog.select("song_id", "track_name", "artist_names", normalize_title("track_name", any_script).alias("t"))
    met = songs.join(q, "t").withColumn("narrow", (F.col("h") != "") & F.contains(F.lower("artist_names"), "h"))
    met = met.withColumn("any", F.max("narrow").over(Window.partitionBy("query_id"))).filter("narrow OR NOT any")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("song_id"))
    return met.withColumn("pos", rank).filter(F.col("pos") <= limit).select("query_id", "pos", "song_id", "track_name", "artist_names", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))


def resolve_playlist(catalog: DataFrame, queries: DataFrame, fuzzy: bool = True, any_script: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds in order of first mention, matches of each query, queries without a match)."""
    matches = find(catalog, queries, fuzzy, 1, any_script)
    seeds = matches.groupBy("song_id").agg(F.min("query_id").alias("pos"))
    unresolved = queries.join(matches.select("query_id"), "query_id", "left_anti")
    return seeds, matches, unresolved


def demo_playlist(catalog: DataFrame, size: int = 4) -> DataFrame:
    """The first titles of the artist with most songs (of equals, the first seen)."""
    busiest = catalog.groupBy("artist_names").agg(F.count("*").alias("n"), F.min("song_id").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return catalog.join(F.broadcast(busiest), "artist_names").orderBy("song_id").limit(size).select("song_id", F.concat_ws(" - ", "track_name", "artist_names").alias("text"))

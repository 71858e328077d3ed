import pytest
from pyspark.sql import functions as F

from latora.functions import text
from latora.sources import catalog as catalogs
from latora.sources import fetch
from latora.sources.synthetic import GENRES, synthetic_catalog, synthetic_frame

FEATURES = ("x", "y")


def songs(spark, rows, columns="Song string, Artist string, x string, y double, genre string"):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize(
    "raw, plain",
    [("Café Song (feat. X)", "cafe song"), ("Tune - Remastered 2011", "tune"), ("Don't Stop", "don t stop"), ("With or Without You", ""), ("(Intro)", ""), ("ﬁne Ǆ ①", "fine dz 1"), ("Über [Live] ft. Y", "uber"), (None, ""), ("日本 語", "日本 語"), ("é" + "́", "e")],
)
def test_title(spark, raw, plain):
    assert text.normalize_text(raw) == plain
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize_title("t")).first()[0] == plain


def test_string_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("saturn", "saturn deluxe edition")], "a string, b string")
    rows = df.select(text.similarity_ratio(F.col("a"), F.col("b")), text.token_overlap(F.col("a"), F.col("b")), text.match_score(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(1 - 3 / 7) and rows[1][0] == 1 and rows[1][1] == 0
    assert rows[2][1] == 1 and rows[2][2] is None


def test_ingest_collapses_by_median_and_first(spark):
    rows = [("A", "P", "1", 1.0, None), ("a ", "p ", "3", 2.0, "g"), ("A!", "P", "9", 9.0, "h"), ("B", "P", "text", 1.0, "g"), ("B", "P", "5", 1.0, "g"), ("C", "Q", "nan", 1.0, "g"), ("D", "Q", "2d", 1.0, "g")]
    out = {r.track_name: r for r in catalogs.ingest(songs(spark, rows), FEATURES).collect()}
    assert set(out) == {"A", "B"}
    assert out["A"].features == [3.0, 2.0] and out["A"].genre == "g" and out["A"].chart_appearances == 3
    assert sorted(r.song_id for r in out.values()) == [0, 1]


def test_csv_quoting(spark, tmp_path):
    path = tmp_path / "charts.csv"
    path.write_text('Title,Artist,energy\n"He said ""hi"", twice",A,0.5\n"two\nlines",B,0.25\n"back\\slash",C,1\n', encoding="utf-8")
    rows = catalogs.read_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('He said "hi", twice', "A", "0.5"), ("two\nlines", "B", "0.25"), ("back\\slash", "C", "1")]


def test_rows_by_id_and_duplicates(spark):
    raw = songs(spark, [("A", "P", "1", 1.0, "g"), ("a", "p", "3", 2.0, "g"), ("B", "P", "text", 1.0, "g"), ("C", "P", "5", 1.0, "g")])
    catalog = catalogs.ingest(raw, FEATURES)
    assert catalogs.duplicates_removed(raw, catalog) == 2
    assert [r.track_name for r in catalogs.lookup(catalog, [1, 99]).collect()] == ["C"] and catalogs.lookup(catalog, []).count() == 0


def test_ingest_errors(spark):
    with pytest.raises(catalogs.CatalogError, match="title"):
        catalogs.ingest(spark.createDataFrame([(1.0,)], "x double"), ("x",))
    with pytest.raises(catalogs.CatalogError, match="missing"):
        catalogs.ingest(spark.createDataFrame([("a",)], "song string"), ("x",))
    with pytest.raises(catalogs.CatalogError, match="several"):
        catalogs.ingest(spark.createDataFrame([("a", "b")], "song string, title string"), ())


def test_popularity_falls_back(spark):
    base = spark.createDataFrame([(0, 5.0, 1), (1, 5.0, 3)], "song_id long, popularity double, chart_appearances long")
    assert [r["pop"] for r in catalogs.with_popularity(base).orderBy("song_id").collect()] == [0.0, 1.0]
    assert {r["pop"] for r in catalogs.with_popularity(base.drop("chart_appearances")).collect()} == {1.0}


def test_lookup(spark):
    catalog = catalogs.ingest(songs(spark, [("Blue Moon", "Ann", "1", 1.0, "g"), ("Blue Moon", "Bob", "1", 1.0, "g"), ("Red Sun", "Bob", "1", 1.0, "g")]), FEATURES)
    queries = spark.createDataFrame([(0, "blue mon"), (1, "Blue Moon - Bob"), (2, "zzz"), (3, "red sun")], "query_id long, text string")
    seeds, matches, lost = catalogs.resolve_playlist(catalog, queries)
    found = {r.query_id: r for r in matches.collect()}
    assert set(found) == {0, 1, 3} and found[1].artist_names == "Bob" and found[1].exact
    assert [r.text for r in lost.collect()] == ["zzz"] and seeds.count() == 3
    assert {r.query_id for r in catalogs.find(catalog, queries, fuzzy=False).collect()} == {1, 3}
    assert catalogs.demo_playlist(catalog).first().text.endswith("Bob")


def test_many_queries_match_as_few_do(spark, monkeypatch):
    """Queries joined by length class, in blocks of songs, find what broadcast ones find."""
    titles = ["sunrise", "sunrises", "sun rise", "a", "ab", "moon", "the long way home tonight", "long way home", "héllo"]
    catalog = spark.createDataFrame([(k, t, f"artist {k % 3}") for k, t in enumerate(titles)], "song_id long, track_name string, artist_names string")
    queries = spark.createDataFrame([(k, t, "artist 1" if k % 2 else "") for k, t in enumerate([*titles, "", "way home", "hello", "sunrisen"])], "query_id long, title string, hint string")
    few = {tuple(r) for r in catalogs.best_matches(catalog, queries).collect()}
    monkeypatch.setattr(catalogs, "QUERY_LIMIT", 2)
    monkeypatch.setattr(catalogs, "SONG_BLOCK", 4)
    assert {tuple(r) for r in catalogs.best_matches(catalog, queries).collect()} == few and len(few) > 12


def test_synthetic(spark):
    frame = synthetic_frame(spark, 200, 20, seed=1)
    assert frame.count() == 290 and frame.select("genre").distinct().count() == len(GENRES)
    assert frame.exceptAll(synthetic_frame(spark, 200, 20, seed=1)).count() == 0
    catalog = synthetic_catalog(spark, 200, 20, seed=1)
    assert catalog.count() <= 200 and catalog.agg(F.max("song_id")).first()[0] == catalog.count() - 1


def test_fetch(tmp_path):
    path = tmp_path / "songs.csv"
    assert fetch.fetch(str(path)) == 1
    good = ",".join(["Title", *catalogs.DEFAULT_FEATURES]) + "\n"
    path.write_text(good)
    assert fetch.fetch(str(path)) == 0 and len(fetch.sha256_of(str(path))) == 64
    other = tmp_path / "other.csv"
    assert fetch.fetch(str(other), path.as_uri()) == 0 and other.read_text() == good
    path.write_text("a,b\n")
    assert not fetch.validate_csv(str(path))[0] and fetch.fetch(str(tmp_path / "x.csv"), path.as_uri()) == 1


def test_capped_distance(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("flaw", "lawn"), ("abc", "")], "a string, b string")
    assert [r[0] for r in df.select(text.levenshtein(F.col("a"), F.col("b"))).collect()] == [3, 2, 3]
    assert [r[0] for r in df.select(text.levenshtein(F.col("a"), F.col("b"), 2)).collect()] == [3, 2, 3]
    assert [r[0] for r in df.select(text.levenshtein(F.col("a"), F.col("b"), 1)).collect()] == [2, 2, 2]


def test_console(monkeypatch):
    import io

    from latora.console import Console, metrics_table, sign

    out = io.TextIOWrapper(io.BytesIO(), encoding="ascii")
    assert sign("ok", out) == "+"
    Console(stream=out).header("café")
    Console(quiet=True, stream=out).ok("nothing")
    out.flush()
    assert out.buffer.getvalue() == b"caf?\n----\n"
    monkeypatch.setenv("LATORA_ASCII", "1")
    assert sign("bar") == "#"
    assert "ndcg@5" in metrics_table([{"system": "a", "ndcg": 0.5, "mrr": 1.0}], ["ndcg", "mrr"], 5)

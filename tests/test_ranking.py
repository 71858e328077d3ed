from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latora.functions.ranking import numbered, quantiles, ranked_within
from latora.operators import cluster, evaluate, explain, metrics, similarity
from latora.operators.recommend import Recommender
from latora.streaming.scoring import title_counts


@pytest.fixture(scope="module")
def songs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 4))
    rows = [(i, f"t{i}", f"Artist {i % 9}", float(i), r) for i, r in enumerate(x.tolist())]
    return x, spark.createDataFrame(rows, "song_id long, track_name string, artist_names string, popularity double, features array<double>")


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_numbered(spark):
    out = numbered(spark.range(1000).withColumn("k", -F.col("id")).repartition(7), "k", "n")
    assert all(r.n == 999 - r.id for r in out.collect())
    assert numbered(spark.range(0), "id", "n").count() == 0


def test_ranked_within_ranges(spark):
    """Groups of any size: dealt by ranges, the places are those of a window."""
    rows = spark.range(3000).select((F.col("id") % 7 % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id").repartition(5)
    pairs = [{(r.id, r.pos) for r in ranked_within(rows, "g", 3000, F.desc("x"), F.col("id"), in_task=limit).collect()} for limit in (10_000, 10)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 3000
    assert ranked_within(rows.limit(0), "g", 3000, F.col("id"), in_task=10).count() == 0


def test_quantiles_of_large_tables(spark):
    """Narrowing gives what one aggregation gives: heavy ties, outliers, few distinct values."""
    rng = np.random.default_rng(2)
    x = np.stack([rng.standard_normal(40_000), np.exp(20 * rng.standard_normal(40_000)), rng.integers(0, 3, 40_000), np.where(np.arange(40_000) < 30_000, 5.0, rng.random(40_000))], axis=1)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    p = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for limit in (1 << 20, 50):
        got = quantiles(df, {c: F.col(c) for c in "abcd"}, p, in_task=limit)
        for k, c in enumerate("abcd"):
            assert np.allclose(got[c], np.quantile(x[:, k], p), rtol=1e-12)


def test_topk_and_matrix(spark, songs):
    x, df = songs
    s = np.clip(units(x) @ units(x).T, -1, 1)
    want = s - 9 * np.eye(len(x))
    for block in (200, 30):  # broadcast, and blocks that meet
        top = similarity.query_topk(df, df.select(F.col("song_id").alias("query_id"), "features"), 5, exclude_self=True, block=block).collect()
        assert {(r.query_id, r.pos): r.song_id for r in top} == {(q, p + 1): int(i) for q in range(len(x)) for p, i in enumerate(np.argsort(-want[q], kind="stable")[:5])}
    for size in (50, 500):
        pairs = similarity.similarity_matrix(df, df, rows_per_block=size, upper=True).toPandas()
        assert len(pairs.drop_duplicates(["i", "j"])) == len(pairs) == 120 * 119 // 2 and np.allclose(pairs.score, s[pairs.i, pairs.j]) and (pairs.i < pairs.j).all()


def test_topk_ties(spark):
    """Of equal scores the lowest ids, in any batch order; more asked than there are."""
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7, 1, 5)], "song_id long, features array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, features array<double>")
    for block in (10, 1):
        got = similarity.query_topk(df, queries, 3, block=block).orderBy("query_id", "pos").collect()
        assert [r.song_id for r in got] == [1, 3, 5, 1, 3, 5] and [r.score for r in got] == [1.0] * 3 + [0.0] * 3
        assert similarity.query_topk(df, queries, 9, block=block).count() == 10
        assert similarity.query_topk(df.limit(0), queries, 3, block=block).count() == 0 and similarity.query_topk(df, queries.limit(0), 3, block=block).count() == 0


@pytest.mark.parametrize("strategy", ["overall_top", "centroid", "mmr", "one_per_song"])
@pytest.mark.parametrize("cap", [None, 1])
def test_strategies(songs, strategy, cap):
    x, df = songs
    seeds, n = [1, 50, 77], 12
    got = Recommender(df, width=4).recommend(seeds, n, strategy, max_per_artist=cap, explain=True).orderBy("pos").toPandas()
    ids = got.song_id.tolist()
    assert not set(ids) & set(seeds) and len(set(ids)) == len(ids)
    if cap:
        assert got.artist_names.value_counts().max() == 1
    sims = np.clip(units(x)[seeds] @ units(x).T, -1, 1)
    free = [i for i in range(120) if i not in seeds]
    if strategy == "overall_top" and not cap:
        assert ids == sorted(free, key=lambda i: (-sims.max(axis=0)[i], i))[:n]
    if strategy == "centroid" and not cap:
        c = x[seeds].mean(axis=0)
        assert ids == sorted(free, key=lambda i: (-(units(x)[i] @ c), i))[:n]
    if strategy == "one_per_song" and not cap:
        want: list = []
        for k in range(n):
            want.append(min((i for i in free if i not in want), key=lambda i, k=k: (-sims[k % 3, i], i)))
        assert ids == want
    if strategy == "mmr" and not cap:
        rel, want = sims.max(axis=0), []
        pool = sorted(free, key=lambda i: (-rel[i], i))[: 20 * n]
        while len(want) < n:
            red = lambda i: max((units(x)[i] @ units(x)[j] for j in want), default=0)
            want.append(max((i for i in pool if i not in want), key=lambda i: (rel[i] if not want else 0.7 * rel[i] - 0.3 * red(i), -pool.index(i))))
        assert ids == want


def test_many_seeds(songs, monkeypatch):
    """Seeds as a matrix score as seeds as literals do."""
    from latora.operators import recommend

    _, df = songs
    engine = Recommender(df, width=4)
    options = [{"strategy": s, "aggregation": a} for s, a in (("overall_top", "max"), ("overall_top", "mean"), ("overall_top", "borda"), ("one_per_song", "max"), ("centroid", "max"))]
    run = lambda: [[(r.song_id, r.seed_id, round(r.score, 9)) for r in engine.recommend([5, 9, 2, 40], 6, negatives=[3, 4], novelty_weight=0.1, **o).orderBy("pos").collect()] for o in options]
    literal = run()
    monkeypatch.setattr(recommend, "LITERAL_SEEDS", 1)
    assert run() == literal


def test_recommend_options(songs):
    _, df = songs
    engine = Recommender(df, width=4)
    assert engine.recommend([], 5).count() == 0 and engine.recommend([1], 0).count() == 0
    with pytest.raises(IndexError):
        engine.recommend([1000])
    with pytest.raises(ValueError):
        engine.recommend([1], -1)
    with pytest.raises(ValueError):
        engine.recommend([1], strategy="other")
    with pytest.raises(ValueError):
        engine.recommend([1], mmr_lambda=2)
    assert engine.recommend([1, 2], 4, aggregation="borda", negatives=[3], novelty_weight=0.2).count() == 4


def test_explanation_sums_to_score(songs):
    x, df = songs
    q = F.array(*map(F.lit, x[0].tolist()))
    r = df.select("song_id", explain.similarity_score(q, F.col("features"), 4).alias("s"), explain.contributions(q, F.col("features"), 4, 4).alias("c")).collect()
    assert all(sum(t.contribution for t in row.c) == pytest.approx(row.s) for row in r)
    zero = df.limit(1).select(explain.contributions(F.array(*[F.lit(0.0)] * 4), F.col("features"), 4).alias("c"))
    assert zero.first().c == [] and zero.select(explain.summary(F.col("c"))).first()[0] == explain.NOTHING_SHARED


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 3, 7), (1, 1, 5)], "query_id long, pos int, song_id long")
    relevant = spark.createDataFrame([(0, 6), (0, 9), (2, 1)], "query_id long, song_id long")
    got = {r.query_id: r for r in metrics.ranking_metrics(ranked, relevant, 3).collect()}
    assert got[0].hit_rate == 1 and got[0].precision == pytest.approx(1 / 3) and got[0].recall == 0.5 and got[0].mrr == 0.5
    assert got[0].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3))) and got[0].average_precision == pytest.approx(0.25)
    assert got[1].hit_rate == got[1].ndcg == 0 and got[2].recall == 0


def test_metrics_by_label(spark):
    """Relevant by label: as with all pairs laid out, but one large label costs a row for each song."""
    labels = [(i, None if i == 7 else "alone" if i == 6 else "ab"[i % 2]) for i in range(8)]
    songs = spark.createDataFrame(labels, "song_id long, label string")
    ranked = spark.createDataFrame([(q, p, (q + p * 3) % 8) for q in range(8) for p in (1, 2, 3)], "query_id long, pos int, song_id long")
    pairs = [(a, b) for a, x in labels for b, y in labels if a != b and x is not None and x == y]
    want = {r.query_id: r for r in metrics.ranking_metrics(ranked, spark.createDataFrame(pairs, "query_id long, song_id long"), 3).collect()}
    assert {r.query_id: r for r in metrics.label_ranking_metrics(ranked, songs, 3).collect()} == want and len(want) == 8
    n = 200_000
    crowd = spark.range(n).select(F.col("id").alias("song_id"), F.lit("x").alias("label"))
    one = spark.createDataFrame([(0, 1, 5)], "query_id long, pos int, song_id long")
    found = metrics.label_ranking_metrics(one, crowd, 3)
    assert found.filter("query_id = 0").first().recall == pytest.approx(1 / (n - 1)) and found.count() == n


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_pairs_shuffle_no_copies(spark, monkeypatch):
    """Blocks that meet are read again, not copied by a shuffle for every pair of them."""
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 64)
    x = np.random.default_rng(1).standard_normal((1024, 32))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "song_id long, features array<double>").repartition(2)
    before = shuffled(spark)
    assert similarity.similarity_matrix(df, df, rows_per_block=64, upper=True).count() == 1024 * 1023 // 2
    assert shuffled(spark) - before < 5 * x.nbytes
    top = similarity.query_topk(df, df.select(F.col("song_id").alias("query_id"), "features"), 3, exclude_self=True, block=30)
    want = np.argsort(-(units(x) @ units(x).T - 9 * np.eye(1024)), axis=1, kind="stable")[:, :3]
    assert {(r.query_id, r.pos): r.song_id for r in top.collect()} == {(q, p + 1): int(want[q, p]) for q in range(1024) for p in range(3)}


def test_blocks_are_kept_once(spark):
    """On disk is one copy of the vectors, and no shuffle file that nothing reads again."""
    x = np.random.default_rng(1).standard_normal((4096, 32))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "song_id long, features array<double>").repartition(2)
    store = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(p.stat().st_size for p in store.rglob("*") if p.is_file())
    kept, dealt = size(), shuffled(spark)
    pairs = similarity.similarity_matrix(df, df, rows_per_block=256, upper=True)
    # the rows of ``df`` are dealt once by this test, and once for blocks
    assert size() - kept < 1.5 * x.nbytes and shuffled(spark) - dealt < 2.8 * x.nbytes
    assert pairs.count() == 4096 * 4095 // 2
    one = similarity.similarity_matrix(df.limit(1), df, rows_per_block=256).toPandas()
    assert len(one) == 4096 and one.j.is_unique and similarity.similarity_matrix(df.limit(0), df).count() == 0


def test_evaluation(spark, songs):
    _, df = songs
    catalog = df.withColumn("pop", F.col("popularity") / 119)
    seeds, relevant = evaluate.build_groups(catalog, min_group_size=6)
    assert seeds.count() == 27 and seeds.join(relevant, ["query_id", "song_id"]).count() == 0
    rankers = [evaluate.RandomRanker(catalog), evaluate.PopularityRanker(catalog), evaluate.VectorRanker("raw_cosine", df), evaluate.VectorRanker("mean", df, "mean"), evaluate.VectorRanker("borda", df, "borda")]
    scores = evaluate.compare(rankers, seeds, relevant, catalog, df, 4, 5).persist()
    assert scores.groupBy("system").count().count() == 5 and evaluate.summary(scores).count() == 5
    tests = evaluate.holm(evaluate.paired_bootstrap(scores, n_resamples=500)).collect()
    assert len(tests) == 4 and all(t.adjusted_p >= t.p for t in tests)
    assert all(r.low <= r["mean"] <= r.high for r in evaluate.bootstrap_ci(scores, n_resamples=300).collect())
    for ranker in rankers:
        assert ranker.rank(seeds, 5).join(seeds, ["query_id", "song_id"]).count() == 0


def test_holm(spark):
    p = [0.001, 0.009, 0.02, 0.04, 0.3, 0.6, 0.9]
    out = evaluate.holm(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "system string, p double")).orderBy("p").collect()
    assert out[0].adjusted_p == pytest.approx(0.007) and [r.significant for r in out][:2] == [True, False]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((60, 2)) + c for c in ((0, 0), (12, 0), (0, 12))])
    df = spark.createDataFrame([(i, int(i // 60), r) for i, r in enumerate(x.tolist())], "song_id long, label int, features array<double>")
    result, found = cluster.compare_to_labels(df, "label", n_restarts=3)
    assert found["adjusted_rand_index"] == pytest.approx(1) and found["purity"] == 1 and found["silhouette"] > 0.7 and result.converged
    assert found["verdict"].startswith("clusters and labels: good agreement")
    with pytest.raises(ValueError):
        cluster.kmeans(df, 0)
    one = cluster.agreement(df.withColumn("one", F.lit(1)), "one", "label").first()
    assert one.adjusted_rand == 0 and one.nmi == 0
    same = cluster.kmeans(df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))), 3, n_restarts=2)
    assert same.inertia == 0 and same.converged
    lonely = cluster.kmeans(df, 5, n_restarts=1, single_step=True)
    assert lonely.n_iter == 1


def test_stream_counts(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2020-01-01 00:10", "2020-01-01 00:20", "2020-01-01 03:00"]), "track_name": ["A!", "a", "b"]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, track_name string").parquet(str(tmp_path / "in"))
    query = title_counts(stream).writeStream.outputMode("complete").format("memory").queryName("titles").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.title, r.n) for r in spark.table("titles").collect()} == {("a", 2), ("b", 1)}


def test_best_reduced(spark):
    from latora.operators.analysis import best_reduced

    rows = [("raw_cosine", 0.5), ("svd_k9", 0.5), ("svd_k3", 0.2), ("svd_k2", 0.3)]
    found = best_reduced(spark.createDataFrame(rows, "system string, ndcg double"), "svd_k9")
    assert found == {"best": "svd_k2", "ndcg": 0.3, "full_rank_gap": 0.0}

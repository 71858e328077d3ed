"""Command line: recommend, analyze, evaluate, cluster and fetch-data."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latora import __version__
from latora.console import Console, metrics_table
from latora.functions.ranking import durable
from latora.operators import analysis, cluster, evaluate
from latora.operators.model import LatentModel, fit_latent_model
from latora.operators.recommend import AGGREGATIONS, STRATEGIES, Recommender
from latora.session import reachable
from latora.sources import catalog as catalogs
from latora.sources.fetch import fetch
from latora.sources.synthetic import synthetic_catalog

METRICS = (*evaluate.METRICS, "coverage")


def parse_k(text: str) -> int | str:
    return int(text) if text.lstrip("-").isdigit() else text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latora", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--data", help="CSV file with a header")
    shared.add_argument("--synthetic", action="store_true")
    shared.add_argument("--synthetic-songs", type=int, default=3000)
    shared.add_argument("--no-dedup", action="store_true")
    shared.add_argument("--k", type=parse_k, default="variance")
    shared.add_argument("--variance-threshold", type=float, default=0.9)
    shared.add_argument("--scaling", default="zscore", choices=["zscore", "robust", "none"])
    shared.add_argument("--whiten", action="store_true")
    shared.add_argument("--backend", default="tsqr", choices=["tsqr", "gram", "randomized"])
    shared.add_argument("--seed", type=int, default=0)
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--quiet", action="store_true")
    c = commands.add_parser("recommend", parents=[shared])
    c.add_argument("--playlist", nargs="*", default=[])
    c.add_argument("--avoid", nargs="*", default=[])
    c.add_argument("--strategy", default="mmr", choices=[*STRATEGIES, "all"])
    c.add_argument("--aggregation", default="max", choices=AGGREGATIONS)
    c.add_argument("-n", type=int, default=10)
    c.add_argument("--max-per-artist", type=int, default=2)
    c.add_argument("--novelty", type=float, default=0.0)
    c.add_argument("--mmr-lambda", type=float, default=0.7)
    c.add_argument("--explain", action="store_true")
    c.add_argument("--exact", action="store_true")
    c = commands.add_parser("analyze", parents=[shared])
    c.add_argument("--save-model")
    c = commands.add_parser("evaluate", parents=[shared])
    c.add_argument("--group-by", default="artist", choices=["artist", "genre"])
    c.add_argument("--seed-size", type=int, default=3)
    c.add_argument("--min-group-size", type=int, default=6)
    c.add_argument("--max-groups", type=int, default=400)
    c.add_argument("--at-k", type=int, default=10)
    c.add_argument("--test-metric", default="ndcg")
    c = commands.add_parser("cluster", parents=[shared])
    c.add_argument("--clusters", type=int)
    c.add_argument("--label-column", default="genre")
    c = commands.add_parser("fetch-data")
    c.add_argument("--data", default="data/songs.csv")
    c.add_argument("--url")
    c.add_argument("--force", action="store_true")
    return top


def load(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.synthetic:
        return synthetic_catalog(spark, args.synthetic_songs, seed=args.seed)
    if not args.data:
        raise FileNotFoundError("no dataset: give --data FILE, run fetch-data, or use --synthetic")
    try:
        raw = catalogs.read_csv(spark, args.data)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"dataset not found at {args.data!r}: run fetch-data, or use --synthetic") from None
        raise
    return catalogs.ingest(raw, deduplicate=not args.no_dedup)


def fit(songs: DataFrame, args: argparse.Namespace, k: int | str | None = None, whiten: bool | None = None) -> LatentModel:
    return fit_latent_model(songs, catalogs.DEFAULT_FEATURES, args.k if k is None else k, args.scaling, args.whiten if whiten is None else whiten, args.backend, args.variance_threshold, args.seed)


def describe_model(model: LatentModel) -> dict:
    return {"k": model.k, "rank_strategy": model.selection.strategy, "explained_variance": model.explained_variance().tolist(), "components": [model.describe_component(c + 1) for c in range(model.k)]}


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def say(args: argparse.Namespace, *lines: str) -> None:
    console = Console(args.quiet or args.json)
    for line in lines:
        console.print(line)


def ids_of(spark: SparkSession, songs: DataFrame, texts: Sequence[str], exact: bool) -> tuple[list[int], list[str]]:
    if not texts:
        return [], []
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    seeds, _, unresolved = catalogs.resolve_playlist(songs, queries, not exact)
    return [r.song_id for r in seeds.orderBy("pos").collect()], [r.text for r in unresolved.collect()]


def recommend(spark: SparkSession, args: argparse.Namespace) -> int:
    songs = load(spark, args)
    texts = args.playlist or [r.text for r in catalogs.demo_playlist(songs).collect()]
    seeds, lost = ids_of(spark, songs, texts, args.exact)
    avoid, _ = ids_of(spark, songs, args.avoid, args.exact)
    for text in lost:
        print(f"not found: {text}", file=sys.stderr)
    if not seeds:
        print("nothing in the playlist was found", file=sys.stderr)
        return 1
    model = fit(songs, args)
    engine = Recommender(songs, model)
    cap = args.max_per_artist if args.max_per_artist > 0 else None
    results = {}
    for strategy in STRATEGIES if args.strategy == "all" else [args.strategy]:
        found = engine.recommend(seeds, args.n, strategy, args.aggregation, cap, args.novelty, avoid, mmr_lambda=args.mmr_lambda, explain=args.explain)
        results[strategy] = rows_of(found.orderBy("pos"))
    if args.json:
        print(json.dumps({"catalog_size": songs.count(), "unresolved": lost, "results": results, "model": describe_model(model)}))
        return 0
    say(args, str(model.selection))
    for strategy, rows in results.items():
        Console().header(f"\n{strategy}")
        for r in rows:
            print(f"{r['pos']:3d}  {r['score']:.3f}  {r['track_name']} - {r['artist_names']}" + (f"\n       {r['summary']}" if args.explain else ""))
    return 0


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    songs = load(spark, args)
    model = fit(songs, args)
    n = songs.count()
    ranks = analysis.three_ranks(model.full_spectrum, n, len(model.feature_names), args.variance_threshold)
    if args.save_model:
        model.save(spark, args.save_model)
    if args.json:
        print(json.dumps({"catalog_size": n, "model": describe_model(model), "singular_values": model.full_spectrum.tolist(), "ranks": ranks}))
        return 0
    say(args, str(model.selection), *(f"{name}: {k}" for name, k in ranks.items()))
    for r in analysis.scree(spark, model.full_spectrum).collect():
        print(f"{r.component:2d}  {r.sigma:10.3f}  {100 * r.share:5.1f}%  {100 * r.cumulative:5.1f}%  {Console().bar(r.share)}")
    for c in range(model.k):
        print(f"LF{c + 1}: {model.describe_component(c + 1)}")
    return 0


def run_evaluation(spark: SparkSession, args: argparse.Namespace) -> int:
    songs = catalogs.with_popularity(load(spark, args))
    full = fit(songs, args, len(catalogs.DEFAULT_FEATURES), False)
    scaled = songs.select("song_id", full.scaler.transform(F.col("features")).alias("features"))
    models = {f"svd_k{k}": fit(songs, args, k, False) for k in (2, 3, 5, 7)} | {"svd_k5_whiten": fit(songs, args, 5, True), "svd_auto": fit(songs, args)}
    latent = {name: songs.select("song_id", m.transform(F.col("features")).alias("features")) for name, m in models.items()}
    label = "artist_names" if args.group_by == "artist" else "genre"
    if label not in songs.columns:
        raise ValueError(f"no column {label}")
    seeds, relevant = (durable(x) for x in evaluate.build_groups(songs, label, args.seed_size, args.min_group_size, args.max_groups, args.seed))
    if seeds.isEmpty():
        raise ValueError("no group is large enough")
    scores = durable(evaluate.compare(evaluate.standard_rankers(songs, scaled, latent, args.seed), seeds, relevant, songs, scaled, len(catalogs.DEFAULT_FEATURES), args.at_k))
    systems, tests = rows_of(evaluate.summary(scores)), rows_of(evaluate.holm(evaluate.paired_bootstrap(scores, metric=args.test_metric)))
    if args.json:
        protocol = {"group_by": args.group_by, "seed_size": args.seed_size, "min_group_size": args.min_group_size, "k": args.at_k}
        print(json.dumps({"protocol": protocol, "systems": systems, "ci": rows_of(evaluate.bootstrap_ci(scores)), "paired_tests_vs_raw_cosine": tests}))
        return 0
    print(metrics_table(systems, METRICS, args.at_k))
    for t in tests:
        print(f"{t['system']:16s} {t['difference']:+.4f} [{t['low']:+.4f}, {t['high']:+.4f}] p={t['p']:.4f} adjusted={t['adjusted_p']:.4f}")
    return 0


def run_cluster(spark: SparkSession, args: argparse.Namespace) -> int:
    songs = load(spark, args)
    if args.label_column not in songs.columns:
        raise ValueError(f"no column {args.label_column!r}")
    model = fit(songs, args)
    points = songs.select("song_id", F.col(args.label_column).alias("label"), model.transform(F.col("features")).alias("features"))
    result, found = cluster.compare_to_labels(points, "label", args.clusters, seed=args.seed)
    pairs = result.assign(points).join(points.select("song_id", "label"), "song_id")
    table = rows_of(cluster.confusion_table(pairs, "cluster", "label").orderBy("cluster"))
    if args.json:
        print(json.dumps(found | {"confusion": table}))
        return 0
    say(args, f"{found['verdict']}")
    for name in ("adjusted_rand_index", "normalized_mutual_information", "purity", "silhouette"):
        print(f"{name}: {found[name]:.4f}")
    for r in table:
        print(r)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "fetch-data":
        return fetch(args.data, args.url, args.force)
    spark = SparkSession.builder.appName("latora").getOrCreate()
    reachable(spark)
    try:
        return {"recommend": recommend, "analyze": analyze, "evaluate": run_evaluation, "cluster": run_cluster}[args.command](spark, args)
    except (FileNotFoundError, ValueError, IndexError, KeyError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())

"""Numbering and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latora.session import shared_folder

#: Groups of up to so many rows are ranked, or have their quantiles taken, within one task.
IN_TASK = 1 << 20
ACCURACY = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, spent: bool = False) -> DataFrame:
    """Write to the checkpoint folder the cluster names and read back.

    ``spent`` removes the shuffle files that led to ``df`` at once, and not whenever the driver happens to collect garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if not spent:
        return df.checkpoint(eager=True)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # a plan of its own: those of ``df`` itself, if it ran before, keep their files
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of column ``by``, whatever their number.

    Rows are dealt by ranges and sorted within each; a row's id then tells its range and its
    place there. The ranges' counts, one row a task, give the starts. The dealt rows are kept
    durably, as a second dealing could differ.
    """
    dealt = durable(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    starts, at = [], 0
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], at))
        at += r["count"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _first long"))
    return dealt.withColumn("_part", part).join(first, "_part", "left").withColumn(name, F.col("_first") + within).drop("_part", "_first", "_place")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, group: list[str], k: int, *order: Column | str, name: str = "pos") -> DataFrame:
    """The first k rows of each group, with their places; the limit reaches each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def ranked_within(df: DataFrame, group: str, size: int, *order: Column, name: str = "pos", in_task: int = IN_TASK) -> DataFrame:
    """Rows numbered from 1 within each group of at most ``size`` rows.

    Groups that fit are a window. Larger ones are dealt by ranges of (group, order) and sorted
    there; a row's place is its place in its range, after the group's rows in the ranges before.
    The dealt rows are kept durably, as a second dealing could differ.
    """
    if size <= in_task:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    dealt = durable(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_place", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_place", 33))
    # a row for each range and each group that begins in it
    starts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(group, "_part", (F.col("_first") - before).alias("_start"))
    return dealt.join(starts, [group, "_part"]).withColumn(name, F.col("_place") - F.col("_start") + 1).drop("_part", "_place", "_start")


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float], in_task: int = IN_TASK) -> dict[str, list[float]]:
    """Exact quantiles of some columns without nulls, interpolated between neighbours; bounded memory at any size.

    A small table is one aggregation. In a larger one sketches enclose each order statistic that
    is needed between two values, and counts tell which it is, or how many rows lie strictly
    between them; that goes on within those rows until few are left.
    """
    named = df.select(*(c.cast("double").alias(n) for n, c in columns.items()))
    n = named.count()
    if not n:
        raise ValueError("no rows")
    if n <= in_task:
        row = named.agg(*(F.percentile(c, F.array(*map(F.lit, probabilities))).alias(c) for c in columns)).first()
        return {c: list(row[c]) for c in columns}
    wanted = sorted({int(p * (n - 1)) + d for p in probabilities for d in (0, 1) if int(p * (n - 1)) + d < n})
    open_ranges = {(c, r): (None, None, 0, n) for c in columns for r in wanted}  # above, below, rows up to the first, rows between
    found: dict[tuple[str, int], float] = {}
    while open_ranges:
        inside = {}
        for (c, _), (low, high, _, _) in open_ranges.items():
            inside[c, low, high] = F.when((F.col(c) > low if low is not None else F.lit(True)) & (F.col(c) < high if high is not None else F.lit(True)), F.col(c))
        asked = []
        for k, ((c, r), (low, high, below, rows)) in enumerate(open_ranges.items()):
            at = (r - below + 0.5) / rows
            exact = rows <= in_task
            # with few rows the very value is taken; else two that enclose it, as the sketch errs by 1 / ACCURACY
            shares = [min(1.0, (r - below) / max(1, rows - 1))] if exact else [max(0.0, at - 3 / ACCURACY), min(1.0, at + 3 / ACCURACY)]
            x = inside[c, low, high]
            asked.append((F.percentile(x, F.array(*map(F.lit, shares))) if exact else F.percentile_approx(x, F.array(*map(F.lit, shares)), ACCURACY)).alias(f"x{k}"))
        got = named.agg(*asked).first()
        counts, bounds = [], {}
        for k, ((c, r), (_, _, _, rows)) in enumerate(open_ranges.items()):
            if rows <= in_task:
                found[c, r] = float(got[f"x{k}"][0])
                continue
            low, high = map(float, got[f"x{k}"])
            bounds[c, r] = (low, high, k)
            counts += [F.count_if(F.col(c) < low).alias(f"a{k}"), F.count_if(F.col(c) <= low).alias(f"b{k}"), F.count_if(F.col(c) < high).alias(f"c{k}"), F.count_if(F.col(c) <= high).alias(f"d{k}")]
        if not bounds:
            break
        row = named.agg(*counts).first()
        rest = {}
        for (c, r), (low, high, k) in bounds.items():
            a, b, d, e = (row[f"{x}{k}"] for x in "abcd")
            was = open_ranges[c, r]
            if r < a:
                rest[c, r] = (was[0], low, was[2], a - was[2])
            elif r < b:
                found[c, r] = low
            elif r < d:
                rest[c, r] = (low, high, b, d - b)
            elif r < e:
                found[c, r] = high
            else:
                rest[c, r] = (high, was[1], e, was[3] + was[2] - e)
        open_ranges = rest
    out = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            at = p * (n - 1)
            low = found[c, int(at)]
            high = found.get((c, int(at) + 1), low)
            out[c].append(low + (at - int(at)) * (high - low))
    return out

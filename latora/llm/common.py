"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latora.session import reachable, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. The shuffle files that led
    to ``df`` are removed at once, as nothing reads them again, and not whenever the driver happens to collect garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # a plan of its own: those of ``df`` itself, if it ran before, keep their files
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: A key that more than one in so many rows have, and more than so many rows, is hot.
HOT_SHARE, HOT_ROWS = 1000, 1000


def spread_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that hot values don't put into one task.

    ``one`` has one row for each key and in ``n`` how many rows of ``many`` have that key. Fewer
    than ``HOT_SHARE`` keys can be hot; their rows of ``one``, which are short, are broadcast and the
    rows of ``many`` stay where they are. All other keys are shuffled.
    """
    rows = one.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    cold_rows = max(HOT_ROWS, (rows.total or 0) // HOT_SHARE)
    if (rows.most or 0) <= cold_rows:
        return many.join(one, key)
    is_hot = F.col("n") > cold_rows
    hot = F.broadcast(checkpointed(one.filter(is_hot)))
    cold = many.join(hot.select(key), key, "left_anti").join(one.filter(~is_hot), key)
    return many.join(hot, key).unionByName(cold)


#: Rows of an Arrow batch. Batches are counted in rows, and texts are long: at the engine's
#: default of 10,000 a batch of documents takes tens of MB, several times over, in each task.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, a setting of the session from here on."""
    spark = df.sparkSession
    reachable(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def row_slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of a few rows, so that per-word lists stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")

"""What the operators share on a cluster: staged tables, ranks, components.

Every intermediate table goes to the folder that ``spark.checkpoint.dir`` names,
as Parquet written through Spark's committer, so a lost executor costs a task and
never a result.  No operator keeps rows of the corpus on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.staging import drop_staged, scratch, shared_dir, stage_path, staged

__all__ = ["bounded_batches", "components", "drop_staged", "partitions", "ranked", "rows_kept", "scratch", "shared_dir", "stage_path", "staged", "window_target"]

#: Rows of a window partition are kept under this many, whatever the key's weight.
WINDOW_ROWS = 100_000
#: Rows and bytes of an Arrow batch, so a run of very long texts fits a worker.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of limited rows and bytes.

    The settings are the session's, and the same for every operator, so lazy plans do not depend on
    which operator was called last.  A lower limit that the session already has stays.
    """
    for name, limit in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= limit:
            spark.conf.set(key, str(limit))


def rows_kept(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of ``docs`` that ``keep`` (batch, name of the text column -> batches) lets through, whatever the columns are called."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    name = f"c{docs.columns.index(text_col)}"

    def of(batches):
        for batch in batches:
            yield from keep(batch, name)

    return plain.mapInArrow(of, plain.schema).toDF(*docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def window_target(spark: SparkSession, total: int) -> int:
    """Rows that one window partition gets: an even share, at most ``WINDOW_ROWS``."""
    return max(16, min(WINDOW_ROWS, total // (4 * partitions(spark)) + 1))


def ranked(df: DataFrame, by: str, sizes: DataFrame, total: int, order: list, name: str = "rank") -> DataFrame:
    """Add ``name``: the 0-based rank of a row among those of equal ``by``.

    ``sizes`` has (``by``, cnt), one row a class, of bounded length.  A class of
    any weight is cut into sub-partitions by a hash of the ordering columns; each
    is ranked alone and shifted by the rows of those before it, so no class ever
    meets in one task.  Ties (rows equal in all of ``order``) take ranks in any order.
    """
    spark = df.sparkSession
    target = window_target(spark, total)
    subs = sizes.select(by, F.ceil(F.col("cnt") / target).cast("int").alias("_subs"))
    cut = df.join(F.broadcast(subs), by).withColumn("_sub", F.pmod(F.xxhash64(*order), F.col("_subs"))).drop("_subs")
    per = Window.partitionBy(by).orderBy("_sub")
    shift = (
        cut.groupBy(by, "_sub").agg(F.count("*").alias("_n"))
        .select(by, "_sub", (F.sum("_n").over(per) - F.col("_n")).alias("_shift"))
    )
    inner = Window.partitionBy(by, "_sub").orderBy(*order)
    return (
        cut.withColumn("_at", F.row_number().over(inner) - 1)
        .join(shift, [by, "_sub"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_sub", "_shift")
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of the undirected ``edges`` (a, b); comp is the least node reachable.

    Alternating large-star and small-star steps over staged edge tables until the
    edge set stands still.  The least neighbours are staged before they are joined: a hub's
    edges then meet them by broadcast or in a join that AQE splits, not where they were counted.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a <> b").distinct(), name)
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        now = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)

"""The matcher on labelled pairs, each pair isolated, and candidate pairs to label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import classify, clustering


def pair_articles(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Both sides of labelled pairs as articles of one time, tagged with ``pair_id``."""
    named = entities.select(F.col("id").alias("_e"), "name")
    own = pairs.select("pair_id", F.explode("entities").alias("name")).join(named, "name").groupBy("pair_id").agg(F.array_sort(F.collect_set("_e")).alias("ids"))
    both = pairs.drop("entities").join(own, "pair_id", "left").select("pair_id", "event_type", "ids", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"{x}_title").alias("title"), F.col(f"summary_{x}").alias("summary"), F.col(f"story_key_{x}").alias("key")) for k, x in enumerate("ab")))).alias("s"))
    return both.select(
        "pair_id", F.col("s.side").cast("long").alias("id"), F.col("s.side").alias("arrival"), F.concat(F.lit("https://example.com/"), F.col("s.side")).alias("url"), F.col("s.title").alias("title"), F.col("s.title").alias("text"),
        F.lit("2024-01-01 12:00:00").cast("timestamp").alias("published_at"), "event_type", F.lit("press").alias("category"), F.coalesce("ids", F.array().cast("array<long>")).alias("entities"), F.col("s.summary").alias("llm_summary"), F.col("s.key").alias("story_key"),
    )


def merged_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(pair_id, should_merge, merged, route) by the production fold, all pairs at once."""
    articles = pair_articles(pairs, entities)
    keyed = articles.withColumn("id", F.col("pair_id") * 2 + F.col("id"))
    featured = clustering.features(keyed, entities).withColumn("pair_id", F.floor(F.col("id") / 2))
    placed = clustering.assign(featured, group="pair_id").filter("kind = 'member'")
    second = placed.filter("id % 2 = 1").select(F.floor(F.col("id") / 2).alias("pair_id"), (F.col("id") != F.col("other")).alias("merged"), "route")
    return pairs.select("pair_id", "should_merge").join(second, "pair_id")


def quality(merged: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall."""
    return merged.agg(*classify.confusion(F.col("should_merge"), F.col("merged")))


def candidate_pairs(variants: DataFrame, limit: int = 400) -> DataFrame:
    """The first ``limit`` pairs (earlier, later) of articles of one story, by story and time, to be labelled.

    Every story of several articles has a pair, so ``limit`` stories hold the answer; of those, only
    the stories before the limit is reached and only so many articles of each are joined.
    """
    first = variants.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").orderBy("cluster_id").limit(limit)
    before = F.sum(F.expr("n * (n - 1) / 2")).over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit).select("cluster_id")
    placed = variants.join(F.broadcast(first), "cluster_id").select("cluster_id", "id", F.row_number().over(Window.partitionBy("cluster_id").orderBy("published_at", "id")).alias("n"))
    placed = placed.filter(F.col("n") <= limit + 1)
    a, b = (placed.select("cluster_id", F.col("id").alias(f"{x}_id"), F.col("n").alias(f"n{x}")) for x in "ab")
    return a.join(b, "cluster_id").filter("na < nb").orderBy("cluster_id", "na", "nb").limit(limit).select("cluster_id", "a_id", "b_id")

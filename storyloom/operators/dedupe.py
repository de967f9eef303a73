"""Raw item de-duplication: greedy, in order of arrival, over several keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..plans.staging import staged


def keyed(items: DataFrame) -> DataFrame:
    """(id, key): the keys of each item; those of an empty value do not exist."""
    source = F.col("source_id").cast("string")
    keys = F.array(
        F.when(F.coalesce("source_item_id", F.lit("")) != "", F.concat(F.lit("i:"), source, F.lit(":"), F.col("source_item_id"))),
        F.concat(F.lit("u:"), F.col("canonical_url")),
        F.when(F.coalesce("raw_title", F.lit("")) != "", F.concat(F.lit("t:"), source, F.lit(":"), F.col("raw_title"))),
    )
    return items.select("id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def greedy(items: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Items kept: those that share no key with an earlier kept item, or with ``history`` (an item's keys as above).

    ``id`` is the arrival order.  A dropped item shadows nothing, so in each round an item is
    kept if no undecided item before it has one of its keys, the items after it that share a
    key are dropped, and the rest stay undecided.  Work per round is one aggregation by key.
    """
    pairs = keyed(items)
    if history is not None:
        seen = pairs.join(keyed(history).select("key").distinct(), "key", "left_semi").select("id").distinct()
        pairs = pairs.join(seen, "id", "left_anti")
        items = items.join(seen, "id", "left_anti")
    undecided, kept = staged(pairs.distinct(), "dedupe-pairs"), None
    while not undecided.isEmpty():
        first = undecided.groupBy("key").agg(F.min("id").alias("first"))
        joined = undecided.join(first, "key")
        won = staged(joined.groupBy("id").agg(F.bool_and(F.col("first") == F.col("id")).alias("won")).filter("won").select("id"), "dedupe-kept")
        kept = won if kept is None else kept.union(won)
        taken = undecided.join(won, "id", "left_semi").select("key").distinct()
        gone = undecided.join(taken, "key", "left_semi").select("id").distinct()
        undecided = staged(undecided.join(gone, "id", "left_anti"), "dedupe-pairs")
    bare = items.join(keyed(items).select("id").distinct(), "id", "left_anti")
    return bare if kept is None else items.join(kept, "id", "left_semi").union(bare)


def arrivals(items: DataFrame, now, max_days: int = 7, verify: bool = False) -> DataFrame:
    """Items with a canonical url and hash, without those that are too old by the feed's date.

    Stubs (``stub``) are exempt.  With ``verify`` the page's own date (``page_date``, nullable)
    replaces the feed's after de-duplication; ``dated`` applies it.
    """
    url = urls.canonical(F.col("original_url"))
    out = items.filter("original_url IS NOT NULL AND original_url <> ''").withColumn("canonical_url", url)
    out = out.withColumn("ingest_hash", urls.ingest_hash(F.col("source_id"), F.col("canonical_url"), F.col("raw_title")))
    fresh = F.col("published_at").isNull() | (F.col("published_at") >= F.lit(now) - F.expr(f"INTERVAL {max_days} DAYS"))
    return out.filter(F.coalesce("stub", F.lit(False)) | fresh)


def dated(items: DataFrame, now, max_days: int = 7) -> DataFrame:
    """The page's date replaces the feed's; undated and old items go, stubs stay."""
    out = items.withColumn("published_at", F.when(F.coalesce("stub", F.lit(False)), F.col("published_at")).otherwise(F.coalesce("page_date", "published_at")))
    return out.filter(F.coalesce("stub", F.lit(False)) | (F.col("published_at") >= F.lit(now) - F.expr(f"INTERVAL {max_days} DAYS")))

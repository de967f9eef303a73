"""Rewrites of the story tables: retention, clean-up, merges, splits, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..schemas import category_rank


def surviving(clusters: DataFrame, items: DataFrame, cluster_cut, item_cut) -> tuple[DataFrame, DataFrame]:
    """Clusters seen and items created on or after their cuts."""
    return clusters.filter(F.col("last_seen_at") >= F.lit(cluster_cut)), items.filter(F.col("created_at") >= F.lit(item_cut))


def cascade(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows of ``child`` whose parent is left."""
    left = parent.select(F.col(parent_key).alias("_parent"))
    return child.join(left, child[key] == left["_parent"], "left_semi")


def cleared(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """``child`` with ``key`` set to null where its parent is gone."""
    left = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.join(left, child[key] == left["_parent"], "left").withColumn(key, F.col("_parent")).drop("_parent")


def without_stubs(items: DataFrame, variants: DataFrame, clusters: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drops stub items that are not kept as evidence (``flag``), their variants, and every empty cluster."""
    kept = items.filter(F.coalesce(flag, F.lit(False)) | ~text.is_stub(F.col("raw_title")))
    left = cascade(variants, kept, "raw_item_id")
    return kept, left, cascade(clusters, left, "id", "cluster_id")


def without_bogus(entities: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with a letter in their name, and the bridge rows of those."""
    kept = entities.filter(F.col("name").rlike("[a-zA-Z]"))
    return kept, cascade(bridge, kept, "entity_id")


def without_ids(array: str, ids: list[int]) -> Column:
    """The array without some ids; repeats of others stay."""
    return F.filter(array, lambda x: ~x.isin(ids))


def merged(clusters: DataFrame, variants: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``groups`` maps source to target ids.  Members move, times widen, tokens and entities unite, the first summary stays."""
    to = groups.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    moved = variants.join(to, variants["cluster_id"] == to["_from"], "left").withColumn("cluster_id", F.coalesce("_to", "cluster_id")).drop("_from", "_to")
    mapped = clusters.join(to, clusters["id"] == to["_from"], "left").withColumn("_key", F.coalesce("_to", "id"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    own = F.max_by("headline", F.struct((F.col("id") == F.col("_key")).cast("int"), -F.col("id"))).alias("headline")
    summary = F.min_by("llm_summary", F.when(F.coalesce("llm_summary", F.lit("")) != "", F.struct((F.col("id") != F.col("_key")).cast("int"), F.col("id")))).alias("llm_summary")
    rewritten = mapped.groupBy(F.col("_key").alias("id")).agg(own, F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), union("tokens"), union("entities_agg"), summary)
    size = moved.groupBy("cluster_id").agg(F.count("*").cast("int").alias("source_count"))
    return rewritten.join(size, rewritten["id"] == size["cluster_id"], "left").drop("cluster_id").fillna(0, ["source_count"]), moved


def split(variants: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (variant_id, new_cluster) move to new clusters; a cluster that would lose all keeps all."""
    marked = variants.join(chosen, variants["id"] == chosen["variant_id"], "left")
    own = Window.partitionBy("cluster_id")
    stays = F.count(F.when(F.col("new_cluster").isNull(), 1)).over(own) > 0
    return marked.withColumn("cluster_id", F.when(stays, F.coalesce("new_cluster", "cluster_id")).otherwise(F.col("cluster_id"))).drop("variant_id", "new_cluster")


def rebuilt(variants: DataFrame) -> DataFrame:
    """Clusters from their members alone: times, count, unions of tokens and entities, and the headline.

    The headline is that of the best source, then the earliest, then the least id; one that is
    empty or ``Untitled`` only if there is no other.
    """
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    titled = F.trim(F.coalesce("title", F.lit("")))
    real = ((titled != "") & (F.lower(titled) != "untitled")).cast("int")
    key = F.struct(-real, -category_rank("category"), F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp_ntz")), F.col("id"))
    return variants.groupBy("cluster_id").agg(
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at"), F.count("*").alias("source_count"), union("tokens"), union("entities"),
        F.coalesce(F.nullif(F.min_by(titled, key), F.lit("")), F.lit("Untitled")).alias("headline"),
    )


def carried_tags(bridge: DataFrame, moved: DataFrame) -> DataFrame:
    """A split's tags: those of every cluster, and the same for the clusters (new_cluster) that were cut from it (cluster_id)."""
    cut = moved.select("cluster_id", "new_cluster").distinct()
    return bridge.unionByName(bridge.join(cut, "cluster_id").drop("cluster_id").withColumnRenamed("new_cluster", "cluster_id").select(*bridge.columns))


def unknown_members(variants: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``chosen`` (variant_id, cluster_id) that are no members of that cluster: a split of them must be refused."""
    members = variants.select(F.col("id").alias("variant_id"), "cluster_id")
    return chosen.join(members, ["variant_id", "cluster_id"], "left_anti")


def recomputed(variants: DataFrame) -> DataFrame:
    """Times and counts of clusters from their members alone; ``rebuilt`` gives all derived columns."""
    return variants.groupBy("cluster_id").agg(F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at"), F.count("*").alias("source_count"))


def plausible_roster(count: Column, before: Column) -> Column:
    """20 to 120 names and at most 30 % fewer than before."""
    return (count >= 20) & (count <= 120) & (before.isNull() | (before <= 0) | (count >= before * 0.7))


def roster_diff(existing: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, change): added, removed or kept."""
    a, b = existing.select(F.col("slug").alias("_a")).distinct(), current.select(F.col("slug").alias("_b")).distinct()
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, a["_a"] == b["_b"], "full").select(F.coalesce("_a", "_b").alias("slug"), change.alias("change"))


def upserted(current: DataFrame, incoming: DataFrame, key: str = "slug") -> DataFrame:
    """Get or create by key: known rows take the incoming metadata only if it is not empty."""
    new = incoming.groupBy(key).agg(F.first("name", ignorenulls=True).alias("_name"), F.max_by("metadata", F.coalesce(F.size("metadata"), F.lit(0))).alias("_metadata"))
    both = current.join(new, key, "full")
    value = F.when(F.coalesce(F.size("_metadata"), F.lit(0)) > 0, F.col("_metadata")).otherwise(F.col("metadata"))
    return both.select(key, F.coalesce("name", "_name").alias("name"), value.alias("metadata"))


def counters(log: DataFrame) -> DataFrame:
    """Lifetime counters from an append log of (key, op, value, at): increments since the last absolute set."""
    last = log.filter("op = 'set'").groupBy("key").agg(F.max_by("value", "at").alias("base"), F.max("at").alias("since"))
    added = log.filter("op = 'add'").join(last, "key", "left").filter("since IS NULL OR at > since").groupBy("key").agg(F.sum("value").alias("added"))
    return last.join(added, "key", "full").select("key", (F.coalesce("base", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("value"))


def switched(sources: DataFrame, id: int, on: bool) -> DataFrame:
    """Enable or disable a source; enabling forgets its errors."""
    own = F.col("id") == id
    out = sources.withColumn("status", F.when(own, "approved" if on else "rejected").otherwise(F.col("status")))
    return out.withColumn("fetch_error_count", F.when(own, 0).otherwise(F.col("fetch_error_count"))) if on else out


def health(sources: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Per source: unsupported, disabled, broken, stale, active or unknown, with its items of the last 7 days."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = items.filter(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).groupBy("source_id").agg(F.count("*").alias("recent_items_7d"))
    state = (
        F.when(F.col("status") == "unsupported", "unsupported").when(F.col("status") != "approved", "disabled").when(F.col("fetch_error_count") >= 3, "broken")
        .when(F.col("last_fetched_at").isNull(), "unknown").when(F.col("last_fetched_at") < now - F.expr("INTERVAL 2 HOURS"), "stale").otherwise("active")
    )
    return sources.join(recent, sources["id"] == recent["source_id"], "left").select("id", "name", "category", "status", state.alias("health"), F.coalesce("recent_items_7d", F.lit(0)).alias("recent_items_7d"))


def pipeline_health(sources: DataFrame, as_of: str, interval_minutes: int = 10, excluded: str = "submissions") -> DataFrame:
    """One row: last scan, staleness beyond three intervals, broken sources, degraded if either."""
    now = F.lit(as_of).cast("timestamp_ntz")
    broken = F.count_if((F.col("status") == "approved") & (F.col("fetch_error_count") >= 3) & (F.col("name") != excluded))
    out = sources.agg(F.max("last_fetched_at").alias("last"), broken.alias("broken_sources"))
    stale = F.coalesce(F.col("last") < now - F.expr(f"INTERVAL {3 * interval_minutes} MINUTES"), F.lit(True))
    return out.select(F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_scan_at"), stale.alias("ingest_stale"), "broken_sources", (stale | (F.col("broken_sources") > 0)).alias("degraded"))


def stratified(items: DataFrame, strata: list[tuple[str, Column]], quota: int) -> DataFrame:
    """First stratum in order that still takes an item, oldest first, ``quota`` each.

    A stratum's quota goes to its oldest rows that no earlier stratum has taken; each step
    ranks what is left and keeps the rest by an anti-join.
    """
    left, out = items, None
    for name, rule in strata:
        chosen = left.filter(rule).orderBy("created_at", "id").limit(quota).select(*items.columns).withColumn("stratum", F.lit(name))
        out = chosen if out is None else out.unionByName(chosen)
        left = left.join(chosen.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return out

"""The read side: feed pages, story decorations and aggregates over the story model."""

from __future__ import annotations

import base64
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..schemas import SOURCE_CATEGORY, category_rank, ordinal


def since(value: str | None, now: datetime) -> datetime | None:
    """``24h``, ``7d``, an ISO time or nothing; anything else is a ValueError."""
    if not value:
        return None
    if m := re.fullmatch(r"(\d+)([hd])", value):
        return now - timedelta(**{"hours" if m[2] == "h" else "days": int(m[1])})
    found = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def encode_cursor(at: datetime, id: int) -> str:
    return base64.urlsafe_b64encode(f"{at.isoformat()}:{id}".encode()).decode()


def decode_cursor(cursor: str | None) -> tuple[datetime, int] | None:
    """The (time, id) of a cursor; none for a cursor that does not parse, which starts at the top."""
    try:
        at, _, id = base64.urlsafe_b64decode((cursor or "").encode()).decode().rpartition(":")
        return datetime.fromisoformat(at), int(id)
    except ValueError:
        return None


def page(clusters: DataFrame, tags: DataFrame | None = None, entities: DataFrame | None = None, since: datetime | str | None = None, cursor: tuple | None = None, limit: int = 50) -> DataFrame:
    """Active clusters, newest first, one more than ``limit`` to tell whether more follow.

    ``tags`` and ``entities`` are frames of cluster_id: a cluster needs one row in each that is
    given.  ``cursor`` is the (last_seen_at, id) after which the page starts.
    """
    out = clusters.filter("status = 'active'")
    if since is not None:
        out = out.filter(F.col("last_seen_at") >= F.lit(since))
    for wanted in (tags, entities):
        if wanted is not None:
            out = out.join(wanted, out["id"] == wanted["cluster_id"], "left_semi")
    if cursor is not None:
        at, last = F.lit(cursor[0]), F.lit(cursor[1])
        out = out.filter((F.col("last_seen_at") < at) | ((F.col("last_seen_at") == at) & (F.col("id") < last)))
    return out.orderBy(F.desc("last_seen_at"), F.desc("id")).limit(limit + 1)


def top_variants(variants: DataFrame) -> DataFrame:
    """(cluster_id, top_id, url): the best source's latest variant of each cluster, the least id on a tie."""
    key = F.struct(category_rank("category"), F.coalesce(F.col("published_at"), F.lit("0001-01-01").cast("timestamp_ntz")), -F.col("id"))
    return variants.groupBy("cluster_id").agg(F.max_by(F.struct("id", "url"), key).alias("top")).select("cluster_id", F.col("top.id").alias("top_id"), "top.url")


def best_first() -> list[Column]:
    return [category_rank("category").desc(), F.desc_nulls_last("published_at"), F.asc("id")]


def previews(variants: DataFrame, clusters: DataFrame, limit: int = 3) -> DataFrame:
    """(cluster_id, headlines): other headlines of a cluster, equal ones under title matching once."""
    keyed = variants.withColumn("key", text.title_key(F.col("title"))).filter("key <> ''")
    heads = clusters.select(F.col("id").alias("cluster_id"), text.title_key(F.col("headline")).alias("head"))
    other = keyed.join(heads, "cluster_id").filter("key <> head")
    first = other.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id", "key").orderBy(*best_first()))).filter("n = 1")
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*best_first()))).filter(F.col("n") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("n", F.trim("title").alias("title"))))
    return kept.groupBy("cluster_id").agg(F.transform(ordered, lambda s: s["title"]).alias("headlines"))


def both_ways(relations: DataFrame) -> DataFrame:
    """An unordered relation (a, b, score) read from either side, as an equi-joinable (cluster_id, other, score)."""
    return relations.select(F.col("a").alias("cluster_id"), F.col("b").alias("other"), "score").union(relations.select("b", "a", "score"))


def related(relations: DataFrame, clusters: DataFrame, limit: int = 3) -> DataFrame:
    """The strongest relations of each cluster; inactive ones are dropped after the limit, so fewer can remain."""
    best = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("score"), "other")
    kept = both_ways(relations).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit)
    active = clusters.filter("status = 'active'").select(F.col("id").alias("other"), "headline")
    return kept.join(active, "other").select("cluster_id", "other", "headline", "score", "n")


def strongest_relations(relations: DataFrame, limit: int = 5) -> DataFrame:
    """Relations that neither of their clusters prunes: a cluster keeps its strongest ``limit``, whichever end of them it is."""
    best = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("score"), "a", "b")
    ends = relations.select("a", "b", "score", F.explode(F.array("a", "b")).alias("cluster_id"))
    kept = ends.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit)
    return kept.groupBy("a", "b", "score").agg(F.count("*").alias("ends")).filter("ends = 2").select("a", "b", "score")


def variant_order(literal: bool = False) -> list[Column]:
    """Official, press, other, newest first; ``literal`` is the descending declared order instead."""
    rank = ordinal("category", SOURCE_CATEGORY)
    return [rank.desc() if literal else rank.asc(), F.desc_nulls_last("published_at"), F.asc("id")]


def prominence(clusters: DataFrame, bridge: DataFrame, entities: DataFrame, limit: int = 20, since=None) -> DataFrame:
    """Entities by the number of active clusters, then by name."""
    own = clusters.filter("status = 'active'")
    own = own if since is None else own.filter(F.col("last_seen_at") >= F.lit(since))
    counted = own.join(bridge, own["id"] == bridge["cluster_id"]).groupBy("entity_id").agg(F.countDistinct("cluster_id").alias("cluster_count"))
    named = counted.join(entities, counted["entity_id"] == entities["id"]).select("entity_id", "name", "cluster_count")
    return named.orderBy(F.desc("cluster_count"), "name", "entity_id").limit(limit)


def search(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Names that hold the query, in any case; its ``%`` and ``_`` are wildcards."""
    return entities.filter(F.col("name").ilike(f"%{query}%")).orderBy("name", "id").limit(limit)


def tag_distribution(clusters: DataFrame, bridge: DataFrame) -> DataFrame:
    active = clusters.filter("status = 'active'")
    return active.join(bridge, active["id"] == bridge["cluster_id"]).groupBy("tag").agg(F.countDistinct("cluster_id").alias("cluster_count"))


def oversized(clusters: DataFrame, variants: DataFrame, count: int = 15, hours: float = 120.0, limit: int = 20) -> DataFrame:
    """Active clusters of many variants or a long span, largest first."""
    size = variants.groupBy("cluster_id").agg(F.count("*").alias("variants"))
    span = ((F.unix_micros(F.col("last_seen_at").cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))) / F.lit(3.6e9).cast("double")).alias("span_hours")
    both = clusters.filter("status = 'active'").join(size, F.col("id") == F.col("cluster_id")).select("id", F.substring("headline", 1, 80).alias("headline"), "variants", span)
    big = both.filter((F.col("variants") >= count) | (F.col("span_hours") >= hours))
    return big.orderBy(F.desc("variants"), "id").limit(limit).withColumn("span_hours", F.round("span_hours", 1))


def eligible_posts(clusters: DataFrame, posted: DataFrame, least_sources: int = 2, limit: int = 5) -> DataFrame:
    """Active, corroborated, not an opinion, never posted; oldest first."""
    own = clusters.filter(F.expr("status = 'active' AND event_type <> 'opinion'") & (F.col("source_count") >= least_sources))
    return own.join(posted, own["id"] == posted["cluster_id"], "left_anti").orderBy("first_seen_at", "id").limit(limit)


def rss_document(clusters: DataFrame, top: DataFrame, site: str, limit: int = 50) -> DataFrame:
    """One row: an RSS 2.0 document of the newest active clusters."""

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    newest = clusters.filter("status = 'active'").orderBy(F.desc("last_seen_at"), F.desc("id")).limit(limit).join(top, F.col("id") == F.col("cluster_id"), "left")
    date = F.concat(F.date_format("last_seen_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(F.lit("<item><title>"), safe(F.col("headline")), F.lit("</title><link>"), safe(F.coalesce("url", F.lit(site))), F.lit("</link><guid isPermaLink=\"false\">"), F.col("id").cast("string"), F.lit("</guid><pubDate>"), date, F.lit("</pubDate></item>"))
    rows = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("last_seen_at").cast("timestamp"))).alias("t"), (-F.col("id")).alias("i"), item.alias("x"))))
    body = F.array_join(F.transform(rows, lambda r: r["x"]), "")
    return newest.agg(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Stories</title><link>{site}</link>'), body, F.lit("</channel></rss>")).alias("document"))


def public_sources(sources: DataFrame, synthetic: str = "submissions") -> DataFrame:
    """Approved sources by priority, without the synthetic one, with the public fields alone."""
    return sources.filter((F.col("status") == "approved") & (F.col("name") != synthetic)).orderBy("priority", "id").select("id", "name", "category")


def rate_windows(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Fixed windows in which a client made more than ``limit`` requests; refused ones count."""
    return events.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


def trailing_counts(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows of the same client in the trailing window, the current one included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("t", micros).withColumn("trailing", F.count("*").over(w)).drop("t")

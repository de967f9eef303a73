"""Types, enumerations and thresholds of the story model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Enumerations in their declared order, which is their sort order.
SOURCE_CATEGORY = ["official", "press", "other"]
SOURCE_STATUS = ["candidate", "queued_for_review", "approved", "rejected", "unsupported"]
INGEST_METHOD = ["rss", "html", "api", "reddit", "twitter"]
CONTENT_TYPE = ["article", "video", "podcast", "social_post", "forum_post"]
CLUSTER_STATUS = ["active", "archived", "merged"]
SUBMISSION_STATUS = ["received", "published", "pending_review", "rejected", "duplicate"]
EVENT_TYPE = ["trade", "injury", "lineup", "recall", "waiver", "signing", "prospect", "game", "opinion", "other"]
VALIDATION_METHOD = ["llm", "keyword", "skip"]
VALIDATION_RESULT = ["approved", "rejected", "error"]
POST_STATUS = ["pending", "posted", "failed", "skipped"]

#: Authority of a source when several could name or lead a story.
CATEGORY_RANK = {"official": 3, "press": 2, "other": 1}

SOURCE = "id long, name string, category string, ingest_method string, base_url string, feed_url string, status string, priority int, last_fetched_at timestamp, fetch_error_count int, metadata map<string,string>"
RAW_ITEM = "id long, source_id long, source_item_id string, original_url string, canonical_url string, raw_title string, raw_description string, published_at timestamp, fetched_at timestamp, ingest_hash string, metadata map<string,string>"
VARIANT = "id long, source_id long, category string, url string, title string, published_at timestamp, tokens array<string>, entities array<long>, event_type string, llm_summary string, story_key string"
CLUSTER = "id long, headline string, event_type string, status string, first_seen_at timestamp, last_seen_at timestamp, tokens array<string>, entities_agg array<long>, source_count int, click_count int, game_identifier string, llm_summary string, story_key string"
ENTITY = "id long, name string, slug string, entity_type string, metadata map<string,string>"


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the matcher."""

    score: float = 0.62
    entity_overlap: float = 0.50
    tokens: float = 0.55
    summary_override: float = 0.70
    title: float = 0.85
    title_containment: float = 0.90
    title_jaccard: float = 0.55
    title_shared: int = 6
    name_jaccard: float = 0.40
    name_shared: int = 4
    topic: float = 0.0
    summary_topic: float = 0.45
    max_age_hours: int = 96
    key_agreement: float = 0.50
    relation: float = 0.45
    relations: int = 5


def ordinal(column: Column | str, values: list[str]) -> Column:
    """Declaration order of an enumeration, for sorting; null for values it lacks."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column) if isinstance(column, str) else column)
    return F.when(at > 0, at - 1)


def category_rank(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(0)
    for name, rank in CATEGORY_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out

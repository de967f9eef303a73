"""The desk: model replies, submissions, review lists, migrations, the outbox and what the site shows of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text, urls
from ..schemas import EVENT_TYPE, SUBMISSION_STATUS

# Tags that a model may give.
MODEL_TAGS = ["Trade", "Injury", "Lineup", "Recall", "Waiver", "Signing", "Prospect", "Game", "Barracuda", "Rumors", "Opinion"]
# How loud a tag or event type is shown; others are routine.
TIERS = {"speculation": ["rumors", "rumor", "trade"], "status": ["injury", "waiver"], "confirmed": ["official", "signing", "recall"]}
# The dictionary that a new store begins with.
SEED = {
    "player": [
        "Macklin Celebrini", "Will Smith", "Mikael Granlund", "Tyler Toffoli", "Fabian Zetterlund", "Alexander Wennberg", "Nico Sturm", "Luke Kunin", "Klim Kostin", "Barclay Goodrow", "Carl Grundstrom", "Ty Dellandrea", "Ethan Cardwell",
        "Givani Smith", "Mackenzie Blackwood", "Vitek Vanecek", "Yaroslav Askarov", "Jake Walman", "Mario Ferraro", "Cody Ceci", "Jan Rutta", "Henry Thrun", "Matt Benning", "Jack Thompson", "Shakir Mukhamadullin",
        "Quentin Musty", "Sam Dickinson", "Kasper Halttunen",
    ],
    "coach": ["Ryan Warsofsky", "Brian Wiseman", "Doug Houda", "Thomas Speer"],
    "team": ["San Jose Sharks", "San Jose Barracuda"],
}
# Pages of the site that do not depend on its data, with how often they change and their weight.
SITE_PAGES = [("/", "hourly", 1.0), ("/about", "yearly", 0.5), ("/legal", "yearly", 0.3), ("/submit", "yearly", 0.4)]
# The periodic jobs and their intervals in minutes.
SCHEDULE = {"ingest": 10, "retention": 24 * 60, "stub_cleanup": 24 * 60, "roster": 24 * 60, "posts": 15, "health": 15, "candidates": 24 * 60}


def checked(value: str, values: list[str]) -> str:
    """A filter argument of an enumeration; anything else is a ValueError."""
    if value not in values:
        raise ValueError(f"invalid value {value}")
    return value


# Model replies.


def json_text(reply: Column) -> Column:
    """The JSON in a reply: the whole of it, else that of a fenced block, else its first flat object; null if none parses."""
    parses = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    flat = F.nullif(F.regexp_extract(reply, r"\{[^{}]*\}", 0), F.lit(""))
    return F.coalesce(parses(reply), parses(fenced), parses(flat))


def classification(reply: Column) -> list[Column]:
    """tags, event_type, summary, story_key and low_value of a reply, held to what is allowed."""
    j = json_text(reply)
    at = lambda name: F.get_json_object(j, f"$.{name}")
    tags = F.coalesce(F.from_json(at("tags"), "array<string>"), F.array().cast("array<string>"))
    return [
        F.filter(tags, lambda t: t.isin(MODEL_TAGS)).alias("tags"), F.when(at("event_type").isin(EVENT_TYPE), at("event_type")).otherwise("other").alias("event_type"),
        F.substring(at("summary"), 1, 100).alias("summary"), text.story_key(at("story_key")).alias("story_key"), F.coalesce(F.lower(at("low_value")).isin("true", "yes"), F.lit(False)).alias("low_value"),
    ]


def worth_keeping(items: DataFrame, reply: str) -> DataFrame:
    """Items but those that the model flags as machine-made pages."""
    return items.select("*", classification(F.col(reply))[4].alias("_low")).filter(~F.col("_low")).drop("_low")


def logged(decisions: DataFrame, reply: str = "llm_response") -> DataFrame:
    """Log rows with the reply's verdict parsed once; unknown, not rejected, where there was no reply."""
    return decisions.withColumn("llm_relevant", F.when(F.coalesce(reply, F.lit("")) != "", text.verdict(F.col(reply))))


def backfilled(logs: DataFrame, reply: str = "llm_response") -> DataFrame:
    """The verdict of old log rows that lack one, by the plain marks of the two forms that replies had."""
    low, up = F.lower(reply), F.upper(reply)
    new = low.contains('"relevant": true') | low.contains('"relevant":true')
    old = up.startswith("YES") | up.contains("DECISION: YES")
    return logs.withColumn("llm_relevant", F.coalesce("llm_relevant", F.when(F.col(reply).contains('"relevant"'), new).otherwise(old)))


def retry_after(status: Column, header: Column, attempt: Column, cap: int = 30) -> Column:
    """Seconds until a call is made again, null if it is not: once after 429 (the header's, capped) and after 5xx."""
    wait = F.when(status == 429, F.least(F.coalesce(header, F.lit(1)), F.lit(cap))).when(status >= 500, 1)
    return F.when(attempt < 1, wait)


def backoff(attempt: Column, base: int = 60, most: int = 3) -> Column:
    """Seconds until a failed task runs again: doubling, null after the last try."""
    return F.when(attempt < most, base * F.pow(F.lit(2), attempt).cast("long"))


def due(runs: DataFrame, now: Column) -> DataFrame:
    """(job, last_run) of the jobs whose interval has passed, or that never ran; unknown jobs are never due."""
    every = runs.sparkSession.createDataFrame(list(SCHEDULE.items()), "job string, minutes int")
    last = runs.groupBy("job").agg(F.max("at").alias("last_run"))
    met = every.join(last, "job", "left")
    return met.filter(F.col("last_run").isNull() | (F.col("last_run") + F.expr("make_dt_interval(0, 0, minutes)") <= now)).select("job", "last_run")


# Submissions.


def submissions_page(submissions: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Submitted links, newest first; the domain is that of the url where none is stored."""
    own = submissions if status is None else submissions.filter(F.col("status") == checked(status, SUBMISSION_STATUS))
    named = own.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), urls.domain(F.col("url"))))
    return named.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def already_known(submissions: DataFrame, variants: DataFrame) -> DataFrame:
    """Submissions as duplicates of the first variant of their canonical url; others stay as they are."""
    first = variants.groupBy("url").agg(F.min_by(F.struct("id", "cluster_id"), "id").alias("_v")).withColumnRenamed("url", "_url")
    met = submissions.withColumn("_canonical", urls.canonical(F.col("url"))).join(first, F.col("_canonical") == F.col("_url"), "left")
    return met.select(*(c for c in submissions.columns if c != "status"), F.when(F.col("_v").isNotNull(), "duplicate").otherwise(F.col("status")).alias("status"), F.col("_v.id").alias("variant_id"), F.col("_v.cluster_id").alias("cluster_id"))


def accepted(attempts: DataFrame, key: str = "user_id", at: str = "ts", limit: int = 10, seconds: int = 3600) -> DataFrame:
    """Attempts with ``accepted``: fewer than ``limit`` accepted ones of the key in the trailing window; refused ones never count.

    Times further apart than the window do not touch, so a key's attempts are cut into stretches, each
    of which is gone through in order.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    order = Window.partitionBy(key).orderBy("_t", "_n")
    rows = attempts.withColumn("_t", t).withColumn("_n", F.xxhash64(*attempts.columns))
    fresh = F.coalesce((F.col("_t") - F.lag("_t").over(order) > seconds * 1_000_000).cast("int"), F.lit(0))
    cut = rows.withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(order)).drop("_fresh")

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_t", "_n"])
        held: list[int] = []
        out = []
        for now in frame["_t"].tolist():
            held = [x for x in held if x > now - seconds * 1_000_000]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(now)
        return frame.drop(columns=["_t", "_n", "_stretch"]).assign(accepted=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema)
    return cut.groupBy(key, "_stretch").applyInPandas(of, f"{kinds}, accepted boolean")


def page_fields(html: Column) -> list[Column]:
    """title, description, author and text of a fetched page: declared metadata, else the page's own."""
    meta = lambda key: F.nullif(F.trim(text.strip_tags(F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*["']{key}["'][^>]*\bcontent\s*=\s*["']([^"']*)""", 1))), F.lit(""))
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(text.strip_tags(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), r"\s+", " ")), F.lit(""))
    body = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    plain = F.trim(F.regexp_replace(text.strip_tags(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1>", " ")), r"\s+", " "))
    return [
        F.coalesce(meta("og:title"), inner("title"), inner("h1")).alias("title"), F.coalesce(meta("og:description"), meta("description")).alias("description"),
        meta("author").alias("author"), F.nullif(plain, F.lit("")).alias("text"),
    ]


# Review lists.


def rejected(logs: DataFrame, items: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rejected decisions of items that still exist, newest first, with the heads of their texts."""
    own = logs.filter("result = 'rejected'").orderBy(F.desc("created_at"), F.desc("id"))
    heads = items.select(F.col("id").alias("raw_item_id"), "raw_title", "canonical_url", F.substring("raw_description", 1, 300).alias("raw_description"))
    return own.join(heads, "raw_item_id").orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def health_totals(health: DataFrame) -> DataFrame:
    """One row: sources, healthy ones and broken ones."""
    return health.agg(F.count("*").alias("total"), F.count_if(F.col("health") == "active").alias("healthy"), F.count_if(F.col("health") == "broken").alias("broken"))


def post_stats(posts: DataFrame) -> DataFrame:
    """One row: posts by status, and when the last one was posted."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return posts.agg(F.count("*").alias("total_posts"), n("posted"), n("failed"), n("pending"), n("skipped"), F.max(F.when(F.col("status") == "posted", F.col("posted_at"))).alias("last_posted_at"))


def posts_page(posts: DataFrame, clusters: DataFrame, limit: int = 50) -> DataFrame:
    """Posts, newest first, with the head of the story's headline; null where the story is gone."""
    heads = clusters.select(F.col("id").alias("cluster_id"), F.substring("headline", 1, 100).alias("cluster_headline"))
    newest = posts.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return newest.join(heads, "cluster_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def next_post(eligible: DataFrame, posts: DataFrame, now: Column, cooldown_minutes: int = 5, retries: int = 3) -> DataFrame:
    """The one story to post now, the oldest first: none within the cooldown, none that is posted or failed too often."""
    recent = posts.filter((F.col("status") == "posted") & (F.col("posted_at") > now - F.expr(f"INTERVAL {cooldown_minutes} MINUTES"))).limit(1)
    done = posts.filter((F.col("status") == "posted") | (F.col("retry_count") >= retries)).select("cluster_id").distinct()
    quiet = recent.agg(F.count("*").alias("_n")).filter("_n = 0")
    own = eligible.join(done, eligible["id"] == done["cluster_id"], "left_anti").orderBy("first_seen_at", "id").limit(1)
    return own.crossJoin(F.broadcast(quiet)).drop("_n")  # one row by one row


def frozen(items: DataFrame, variants: DataFrame, logs: DataFrame, members: DataFrame, strata: list[tuple[str, Column]], quota: int) -> DataFrame:
    """Evaluation items: raw items with their variant, decision and story where there are any, the oldest of each stratum.

    An item of several variants or decisions is a row of each until it is taken: the first that its
    stratum admits counts, and the item is taken once, by the first stratum in order.
    """
    joined = (
        items.join(variants.select(F.col("id").alias("variant_id"), F.col("raw_item_id").alias("id")), "id", "left")
        .join(logs.select(F.col("id").alias("log_id"), F.col("raw_item_id").alias("id"), "result", "llm_response", "keyword_matched"), "id", "left")
        .join(members.select("variant_id", "cluster_id"), "variant_id", "left")
    )
    left, out = joined, None
    for name, rule in strata:
        first = Window.partitionBy("id").orderBy(F.asc_nulls_last("variant_id"), F.asc_nulls_last("log_id"), F.asc_nulls_last("cluster_id"))
        chosen = left.filter(rule).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy("created_at", "id").limit(quota).withColumn("stratum", F.lit(name))
        out = chosen if out is None else out.unionByName(chosen)
        left = left.join(chosen.select("id"), "id", "left_anti")
    return out


def write_corpus(records: DataFrame, pairs: DataFrame, path: str) -> None:
    """Two JSONL tables: the items, and the candidate pairs still to be labelled."""
    records.write.mode("overwrite").json(f"{path}/items")
    pairs.withColumn("should_merge", F.lit(None).cast("boolean")).withColumn("label_source", F.lit("unlabelled")).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/pairs")


# Entities.


def without_teams(articles: DataFrame, entities: DataFrame, array: str = "entities") -> DataFrame:
    """``array`` without teams and without ids that the dictionary lacks; no id twice, in id order."""
    people = entities.filter("entity_type <> 'team'").select(F.col("id").alias("_e"), F.col("name").alias("_name"))
    own = articles.select("id", F.explode(array).alias("_e")).distinct().join(people, "_e")
    own = own.groupBy("id").agg(F.array_sort(F.collect_list("_e")).alias("_ids"))
    return articles.join(own, "id", "left").withColumn(array, F.coalesce("_ids", F.array().cast(articles.schema[array].dataType))).drop("_ids")


def names(articles: DataFrame, entities: DataFrame, array: str = "entities") -> DataFrame:
    """(id, names): the names of an article's entities, by id, parted by commas."""
    own = articles.select("id", F.explode(array).alias("_e")).distinct().join(entities.select(F.col("id").alias("_e"), "name"), "_e")
    return own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_e", "name"))), lambda s: s["name"]), ", ").alias("names"))


def holding_any(rows: DataFrame, array: str, ids: DataFrame) -> DataFrame:
    """Rows whose array has one of ``ids`` (id)."""
    met = rows.select("id", F.explode(array).alias("_e")).join(ids.select(F.col("id").alias("_e")), "_e", "left_semi").select("id").distinct()
    return rows.join(met, "id", "left_semi")


def seeded(spark: SparkSession) -> DataFrame:
    """(slug, name, metadata) of the first dictionary, to be upserted by slug."""
    rows = [(name, kind) for kind, own in SEED.items() for name in own]
    frame = spark.createDataFrame(rows, "name string, entity_type string")
    return frame.select(text.slug(F.col("name")).alias("slug"), "name", F.create_map(F.lit("entity_type"), F.col("entity_type")).alias("metadata"))


# Rewrites of stored columns.


def flagged(rows: DataFrame, rule: Column, key: str, value: str = "true") -> DataFrame:
    """Rows of the rule get ``key`` in their metadata; other keys stay."""
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: k != key)
    return rows.withColumn("metadata", F.when(rule, F.map_concat(kept, F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("metadata")))


def unflagged(rows: DataFrame, rule: Column, key: str) -> DataFrame:
    """The way back: the key goes from rows of the rule."""
    return rows.withColumn("metadata", F.when(rule, F.map_filter("metadata", lambda k, _: k != key)).otherwise(F.col("metadata")))


def flag_set(metadata_json: Column, key: str = "ingest_stub") -> Column:
    """Whether a JSON object holds a flag that is true."""
    return F.coalesce(F.get_json_object(metadata_json, f"$.{key}") == "true", F.lit(False))


def emptied(tables: dict[str, DataFrame], children: dict[str, list[str]]) -> list[tuple[str, DataFrame]]:
    """All tables without rows, a table after those that refer to it."""
    out: list[tuple[str, DataFrame]] = []

    def visit(name: str) -> None:
        if name not in [n for n, _ in out]:
            for child in children.get(name, []):
                visit(child)
            out.append((name, tables[name].limit(0)))

    for name in tables:
        visit(name)
    return out


# What the site shows.


def tier(name: Column) -> Column:
    """How loud a tag or event type is shown."""
    low, out = F.lower(F.trim(name)), F.lit("routine")
    for loud, own in TIERS.items():
        out = F.when(low.isin(own), loud).otherwise(out)
    return F.when(name.isNull(), "routine").otherwise(out)


def sitemap(topics: DataFrame, site: str, last_scan: Column, least: int = 10) -> DataFrame:
    """(url, last_modified, change_frequency, priority): the fixed pages, and topics (path, n) of at least ``least`` stories."""
    spark = topics.sparkSession
    fixed = spark.createDataFrame(SITE_PAGES, "path string, change_frequency string, priority double")
    own = topics.filter(F.col("n") >= least).select("path", F.lit("daily").alias("change_frequency"), F.lit(0.7).cast("double").alias("priority"))
    both = fixed.unionByName(own)
    return both.select(F.concat(F.lit(site), "path").alias("url"), F.when((F.col("path") == "/") | (F.col("change_frequency") == "daily"), last_scan).alias("last_modified"), "change_frequency", "priority")


def sitemap_document(rows: DataFrame) -> DataFrame:
    """One row: the sitemap as XML."""
    def tag(name: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))).otherwise("")

    safe = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url>"), tag("loc", safe), tag("lastmod", F.col("last_modified").cast("string")), tag("changefreq", F.col("change_frequency")), tag("priority", F.col("priority").cast("string")), F.lit("</url>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", entry.alias("x")))), lambda s: s["x"]), "")
    return rows.agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>")).alias("document"))

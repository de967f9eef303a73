"""Registered queries of the desk: replies, submissions, review lists, rewrites, site data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text, urls
from ..operators import desk, feed, maintenance
from ..sources import feeds
from .catalog import day, query, strings
from .views import AS_OF, CLUSTERS, ENTITIES, LOGS, SOURCES, VARIANTS, Model

_REPLY = """CASE event_id % 7 WHEN 0 THEN '{"tags": ["Trade", "Bogus", "Game"], "event_type": "trade", "summary": "Short", "story_key": "A Key! no ' || event_id || '", "low_value": false}'
WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{"tags": ["Rumors"], "event_type": "signing", "low_value": "yes"}' || chr(10) || '```' WHEN 2 THEN 'Sure {"event_type": "nonsense", "low_value": "no"} done {"event_type": "game"}'
WHEN 3 THEN 'no object { here' WHEN 5 THEN '{"tags": "Trade", "event_type": "game", "low_value": true}' WHEN 6 THEN '{"summary": "' || repeat('x', 120) || '", "story_key": "--"}' END"""
_FENCED, _FLAT = "regexp_extract(reply, '```(?:json)?\\s*(\\{.*?\\})\\s*```', 1, 's')", "regexp_extract(reply, '\\{[^{}]*\\}')"
_JSON = f"CASE WHEN json_valid(reply) THEN reply WHEN json_valid({_FENCED}) THEN {_FENCED} WHEN json_valid({_FLAT}) THEN {_FLAT} END"
_REPLIES = f"replies AS (SELECT id, reply, {_JSON} AS j FROM (SELECT event_id AS id, {_REPLY} AS reply FROM events))"


def _replies(m: Model) -> DataFrame:
    return m.table("events").select(F.col("event_id").alias("id"), F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply"))


@query(f"WITH {_REPLIES} SELECT id, j AS json FROM replies")
def reply_json(m):
    return _replies(m).select("id", desk.json_text(F.col("reply")).alias("json"))


_KEY = "nullif(trim(substr(trim(regexp_replace(regexp_replace(lower(trim(k)), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), 1, 80), '-'), '')"


@query(f"""WITH {_REPLIES}, p AS (SELECT id, CASE WHEN json_type(j, '$.tags') = 'ARRAY' THEN CAST(json_extract(j, '$.tags') AS VARCHAR[]) ELSE [] END AS t, json_extract_string(j, '$.event_type') AS e, json_extract_string(j, '$.summary') AS s,
json_extract_string(j, '$.story_key') AS k, json_extract_string(j, '$.low_value') AS v FROM replies)
SELECT id, array_to_string(list_filter(t, lambda x: x IN ({', '.join(f"'{t}'" for t in desk.MODEL_TAGS)})), '|') AS tags, CASE WHEN e IN ('trade', 'signing', 'game') THEN e ELSE 'other' END AS event_type, substr(s, 1, 100) AS summary, {_KEY} AS story_key, coalesce(lower(v) IN ('true', 'yes'), false) AS low_value FROM p""")
def model_results(m):
    return _replies(m).select("id", *desk.classification(F.col("reply"))).withColumn("tags", strings("tags"))


@query(f"WITH {_REPLIES} SELECT id FROM replies WHERE NOT coalesce(lower(json_extract_string(j, '$.low_value')) IN ('true', 'yes'), false)")
def items_worth_keeping(m):
    return desk.worth_keeping(_replies(m), "reply").select("id")


@query(f"WITH {LOGS} SELECT id, approved AS llm_relevant FROM logs")
def validation_log(m):
    return desk.logged(m.logs()).select("id", "llm_relevant")


@query(f"""WITH {LOGS} SELECT id, CASE WHEN llm_response LIKE '%"relevant"%' THEN lower(llm_response) LIKE '%"relevant": true%' ELSE upper(llm_response) LIKE 'YES%' END AS llm_relevant FROM logs""")
def verdict_backfill(m):
    return desk.backfilled(m.logs().withColumn("llm_relevant", F.lit(None).cast("boolean"))).select("id", "llm_relevant")


# Submissions are the pages' urls.

_SUBMISSIONS = "submissions AS (SELECT page_id AS id, url, ['received', 'published', 'pending_review', 'rejected', 'duplicate'][page_id % 5 + 1] AS status, CASE WHEN page_id % 3 = 0 THEN 'stored.example.com' END AS domain, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id % 700 AS INTEGER)) AS created_at FROM pages)"


def _submissions(m: Model) -> DataFrame:
    k = F.col("page_id")
    status = F.get(F.array(*map(F.lit, ["received", "published", "pending_review", "rejected", "duplicate"])), (k % 5).cast("int"))
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, CAST(page_id % 700 AS INT))")
    return m.table("pages").select(k.alias("id"), "url", status.alias("status"), F.when(k % 3 == 0, "stored.example.com").alias("domain"), at.alias("created_at"))


@query(f"WITH {_SUBMISSIONS} SELECT id, coalesce(domain, regexp_extract(url, '://([^/?#]*)', 1)) AS domain, status FROM submissions WHERE status = 'pending_review' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5")
def submissions_page(m):
    return desk.submissions_page(_submissions(m), "pending_review", 20, 5).select("id", "domain", "status")


_CANONICAL = """base || CASE WHEN q <> '' THEN '?' || q ELSE '' END"""
_CLEAN = f"""cleaned AS (SELECT id, {_CANONICAL} AS canonical FROM (SELECT id, base, array_to_string(list_filter(q, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_content|utm_term|ref|fbclid)=') AND NOT regexp_matches(x, '=$')), '&') AS q
FROM (SELECT page_id AS id, regexp_extract(url, '^([^?#]*)', 1) AS base, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') AS q FROM pages)))"""


@query(f"""WITH {_SUBMISSIONS}, {_CLEAN}, v AS (SELECT canonical AS url, min(id) AS variant_id FROM cleaned WHERE id % 4 = 0 GROUP BY 1)
SELECT s.id, CASE WHEN variant_id IS NOT NULL THEN 'duplicate' ELSE status END AS status, variant_id, variant_id * 10 AS cluster_id FROM submissions s JOIN cleaned c ON c.id = s.id LEFT JOIN v ON v.url = c.canonical""")
def submission_duplicates(m):
    known = m.table("pages").filter("page_id % 4 = 0").select(F.col("page_id").alias("id"), urls.canonical(F.col("url")).alias("url"), (F.col("page_id") * 10).alias("cluster_id"))
    return desk.already_known(_submissions(m), known).select("id", "status", "variant_id", "cluster_id")


@query(f"""WITH {_SUBMISSIONS}, d AS (SELECT id, regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM submissions), known AS (SELECT DISTINCT domain FROM d WHERE id % 20 = 0)
SELECT domain, count(*) AS times_submitted, min(id) AS first_submission FROM d WHERE domain <> '' AND domain NOT IN (SELECT domain FROM known) GROUP BY 1""")
def candidate_sources(m):
    sources = m.table("pages").filter("page_id % 20 = 0").select(F.col("url").alias("base_url"), F.lit(None).cast("string").alias("feed_url"))
    return feeds.candidate_sources(_submissions(m), sources)


@query("SELECT page_id AS id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pages")
def page_titles(m):
    return m.table("pages").select(F.col("page_id").alias("id"), desk.page_fields(F.col("html"))[0])


@query()
def submissions_accepted(m):
    """Attempts under a limit of two accepted ones in a day; the tests hold it against a plain loop."""
    return desk.accepted(m.table("events").select("event_id", "user_id", "ts"), limit=2, seconds=86400).select("event_id", "user_id", "accepted")


# Review lists.


def _log_items(m: Model) -> tuple[DataFrame, DataFrame]:
    logs = m.logs().withColumn("raw_item_id", F.col("id") % 1500)
    items = m.titles().select("id", F.col("title").alias("raw_title"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("canonical_url"), F.col("text").alias("raw_description"))
    return logs, items


@query(f"""WITH {LOGS} SELECT l.id, id % 1500 AS raw_item_id, substr(split_part(coalesce(d.text, ''), chr(10), 1), 1, 140) AS raw_title, 'https://e.com/' || d.doc_id AS canonical_url, substr(d.text, 1, 300) AS raw_description
FROM logs l JOIN documents d ON d.doc_id = l.id % 1500 WHERE result = 'rejected' ORDER BY l.created_at DESC, l.id DESC LIMIT 50""")
def validations_rejected(m):
    return desk.rejected(*_log_items(m)).select("id", "raw_item_id", "raw_title", "canonical_url", "raw_description")


_HEALTH = f"""CASE WHEN status = 'unsupported' THEN 'unsupported' WHEN status <> 'approved' THEN 'disabled' WHEN fetch_error_count >= 3 THEN 'broken' WHEN last_fetched_at IS NULL THEN 'unknown' WHEN last_fetched_at < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR THEN 'stale' ELSE 'active' END"""


@query(f"WITH {SOURCES}, h AS (SELECT {_HEALTH} AS health FROM sources) SELECT count(*) AS total, count(*) FILTER (WHERE health = 'active') AS healthy, count(*) FILTER (WHERE health = 'broken') AS broken FROM h")
def source_health_totals(m):
    items = m.table("lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("created_at"))
    return desk.health_totals(maintenance.health(m.sources(), items, AS_OF))


_POSTS = "posts AS (SELECT event_id AS id, event_id * 3 AS cluster_id, ['pending', 'posted', 'failed', 'skipped'][event_id % 4 + 1] AS status, CAST(event_id % 5 AS INTEGER) AS retry_count, ts AS created_at, CASE WHEN event_id % 4 = 1 THEN ts END AS posted_at FROM events)"


def _posts(m: Model) -> DataFrame:
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ["pending", "posted", "failed", "skipped"])), (k % 4).cast("int"))
    return m.table("events").select(k.alias("id"), (k * 3).alias("cluster_id"), status.alias("status"), (k % 5).cast("int").alias("retry_count"), F.col("ts").alias("created_at"), F.when(k % 4 == 1, F.col("ts")).alias("posted_at"))


@query(f"WITH {_POSTS} SELECT count(*) AS total_posts, count(*) FILTER (WHERE status = 'posted') AS posted, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'skipped') AS skipped, strftime(max(posted_at), '%Y-%m-%d %H:%M:%S') AS last_posted_at FROM posts")
def posts_stats(m):
    return desk.post_stats(_posts(m)).withColumn("last_posted_at", F.date_format("last_posted_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {CLUSTERS}, {_POSTS} SELECT p.id, p.cluster_id, p.status, substr(headline, 1, 100) AS cluster_headline FROM posts p LEFT JOIN clusters c ON c.id = p.cluster_id ORDER BY p.created_at DESC, p.id DESC LIMIT 50")
def posts_page(m):
    return desk.posts_page(_posts(m), m.clusters()).select("id", "cluster_id", "status", "cluster_headline")


@query(f"""WITH {CLUSTERS}, {_POSTS} SELECT id FROM clusters c WHERE status = 'active' AND event_type <> '5-LOW' AND source_count >= 2 AND NOT EXISTS (SELECT 1 FROM posts p WHERE p.cluster_id = c.id AND (p.status = 'posted' OR retry_count >= 3)) ORDER BY first_seen_at, id LIMIT 1""")
def outbox_next(m):
    c = m.clusters().withColumn("event_type", F.when(F.col("event_type") == "5-LOW", "opinion").otherwise(F.col("event_type")))
    own = c.filter("status = 'active' AND event_type <> 'opinion' AND source_count >= 2")
    return desk.next_post(own, _posts(m), F.lit("2030-01-01").cast("timestamp_ntz")).select("id")


_STRATA = [("stub", "flag"), ("compared", "keyword_matched IS NOT NULL AND llm_response IS NOT NULL AND result <> 'error'"), ("rejected", "result = 'rejected'"), ("low_value_suspect", "variant_id IS NULL AND result = 'approved'"), ("clustered", "cluster_id IS NOT NULL"), ("accepted", "variant_id IS NOT NULL")]


def _freeze_sql(quota: int) -> str:
    """The strata one after another, each without the items of those before."""
    parts = [f"""WITH {LOGS}, joined AS (SELECT d.doc_id AS id, d.n_chars AS created_at, d.doc_id % 17 = 0 AS flag, v.variant_id, l.id AS log_id, result, llm_response, keyword_matched, CASE WHEN v.variant_id % 2 = 0 THEN v.variant_id * 10 END AS cluster_id
FROM documents d LEFT JOIN (SELECT page_id AS variant_id, page_id % 400 AS item FROM pages) v ON v.item = d.doc_id LEFT JOIN logs l ON l.id % 1500 = d.doc_id)"""]
    for k, (name, rule) in enumerate(_STRATA):
        before = "".join(f" AND id NOT IN (SELECT id FROM s{j})" for j in range(k))
        parts.append(f"s{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY variant_id NULLS LAST, log_id NULLS LAST, cluster_id NULLS LAST) AS n FROM joined WHERE ({rule}){before}) WHERE n = 1 ORDER BY created_at, id LIMIT {quota})")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT id, variant_id, log_id, cluster_id, '{name}' AS stratum FROM s{k}" for k, (name, _) in enumerate(_STRATA))


@query(_freeze_sql(30))
def corpus_freeze(m):
    items = m.table("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"), F.to_json(F.struct((F.col("doc_id") % 17 == 0).alias("ingest_stub"))).alias("metadata"))
    items = items.withColumn("flag", desk.flag_set(F.col("metadata"))).drop("metadata")
    variants = m.table("pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 400).alias("raw_item_id"))
    members = variants.filter("id % 2 = 0").select(F.col("id").alias("variant_id"), (F.col("id") * 10).alias("cluster_id"))
    logs = m.logs().withColumn("raw_item_id", F.col("id") % 1500)
    out = desk.frozen(items, variants, logs, members, [(n, F.expr(r)) for n, r in _STRATA], 30)
    return out.select("id", "variant_id", "log_id", "cluster_id", "stratum")


# Entities.

_NATIONS = "nations AS (SELECT n_nationkey AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'team' ELSE 'player' END AS entity_type FROM nation)"
_TAGGED = "articles AS (SELECT s_suppkey AS id, [s_nationkey, (s_nationkey + 7) % 30, s_suppkey % 25, s_nationkey] AS entities FROM supplier)"


def _nations(m: Model) -> DataFrame:
    return m.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "team").otherwise("player").alias("entity_type"))


def _named(m: Model) -> DataFrame:
    n, s = F.col("s_nationkey").cast("long"), F.col("s_suppkey").cast("long")
    return m.table("supplier").select(s.alias("id"), F.array(n, (n + 7) % 30, s % 25, n).alias("entities"))


@query(f"WITH {_NATIONS}, {_TAGGED} SELECT a.id, coalesce((SELECT string_agg(n.id, '|' ORDER BY n.id) FROM nations n WHERE entity_type <> 'team' AND list_contains(a.entities, n.id)), '') AS entities FROM articles a")
def entities_without_teams(m):
    return desk.without_teams(_named(m), _nations(m)).select("id", F.array_join(F.transform("entities", lambda e: e.cast("string")), "|").alias("entities"))


@query(f"WITH {_NATIONS}, {_TAGGED} SELECT a.id, string_agg(n.name, ', ' ORDER BY n.id) AS names FROM articles a JOIN nations n ON list_contains(a.entities, n.id) GROUP BY 1")
def entity_names(m):
    return desk.names(_named(m), _nations(m))


@query(f"WITH {_TAGGED} SELECT id, array_to_string(list_filter(entities, lambda e: e NOT IN (3, 5)), '|') AS entities FROM articles WHERE list_has_any(entities, [3, 5])")
def entities_cleaned(m):
    """Articles that hold ids of bogus entities, without those ids."""
    bogus = m.spark.createDataFrame([(3,), (5,)], "id long")
    own = desk.holding_any(_named(m), "entities", bogus).withColumn("entities", maintenance.without_ids("entities", [3, 5]))
    return own.select("id", F.array_join(F.transform("entities", lambda e: e.cast("string")), "|").alias("entities"))


@query("SELECT slug, name, entity_type FROM (VALUES " + ", ".join(f"('{n.lower().replace(' ', '-')}', '{n}', '{k}')" for k, own in desk.SEED.items() for n in own) + ") t(slug, name, entity_type)")
def seed_dictionary(m):
    """The first dictionary, upserted twice: the second time changes nothing."""
    none = desk.seeded(m.spark).limit(0)
    once = maintenance.upserted(none, desk.seeded(m.spark))
    return maintenance.upserted(once, desk.seeded(m.spark)).select("slug", "name", F.col("metadata")["entity_type"].alias("entity_type"))


# Rewrites.


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'true' END AS flag, CASE WHEN s_suppkey % 2 = 0 THEN 'x' END AS other, 0 AS left_over FROM supplier")
def metadata_flag(m):
    k = F.col("id")
    rows = m.table("supplier").select(F.col("s_suppkey").alias("id")).withColumn("metadata", F.when(k % 2 == 0, F.create_map(F.lit("other"), F.lit("x"))))
    out = desk.flagged(rows, k % 3 == 0, "description_unreliable")
    back = desk.unflagged(out, k % 3 == 0, "description_unreliable").filter(F.map_contains_key("metadata", F.lit("description_unreliable"))).agg(F.count("*").cast("int").alias("left_over"))
    return out.select("id", F.try_element_at("metadata", F.lit("description_unreliable")).alias("flag"), F.try_element_at("metadata", F.lit("other")).alias("other")).join(F.broadcast(back))  # one row


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN 'unsupported' WHEN s_suppkey % 2 = 0 THEN 'approved' ELSE 'candidate' END AS status FROM supplier")
def sources_unsupported(m):
    k = F.col("s_suppkey")
    rows = m.table("supplier").select(k.alias("id"), F.when(k % 2 == 0, "approved").otherwise("candidate").alias("status"), F.when(k % 3 == 0, "rss").otherwise("html").alias("ingest_method"))
    return feeds.unsupported(rows).select("id", "status")


@query(f"WITH {SOURCES} SELECT id, CASE id WHEN 7 THEN 'approved' WHEN 8 THEN 'rejected' ELSE status END AS status, CASE id WHEN 7 THEN 0 ELSE fetch_error_count END AS fetch_error_count FROM sources")
def sources_switched(m):
    return maintenance.switched(maintenance.switched(m.sources(), 7, True), 8, False).select("id", "status", "fetch_error_count")


@query("""WITH s AS (SELECT event_type AS key, arg_max(value, event_id) AS base, max(event_id) AS since FROM events WHERE event_id % 50 = 0 GROUP BY 1)
SELECT e.event_type AS key, round(coalesce(max(base), 0) + coalesce(sum(value) FILTER (WHERE event_id % 50 <> 0 AND (since IS NULL OR event_id > since)), 0), 4) AS value FROM events e LEFT JOIN s ON s.key = e.event_type GROUP BY 1""")
def click_counters(m):
    e = m.table("events")
    log = e.select(F.col("event_type").alias("key"), F.when(F.col("event_id") % 50 == 0, "set").otherwise("add").alias("op"), "value", F.col("event_id").alias("at"))
    return maintenance.counters(log).select("key", F.round("value", 4).alias("value"))


@query(f"""WITH {VARIANTS}, x AS (SELECT *, tag = 'R' AND count(*) FILTER (WHERE tag <> 'R') OVER (PARTITION BY cluster_id) > 0 AS moved FROM variants), y AS (SELECT *, CASE WHEN moved THEN cluster_id + 1000000000 ELSE cluster_id END AS k FROM x)
SELECT k AS cluster_id, count(*) AS source_count, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tokens, arg_min(title, (-rank, published_at, id)) AS headline FROM y GROUP BY 1""")
def split_recomputed(m):
    v = m.variants().withColumn("tokens", F.array("tag")).withColumn("entities", F.array(F.col("source_id")))
    chosen = v.filter("tag = 'R'").select(F.col("id").alias("variant_id"), (F.col("cluster_id") + 1_000_000_000).alias("new_cluster"))
    out = maintenance.rebuilt(maintenance.split(v, chosen))
    return out.select("cluster_id", "source_count", strings("tokens").alias("tokens"), "headline")


# Site data.


@query("SELECT event_type AS name, count(*) AS n, CASE WHEN event_type IN ('purchase') THEN 'routine' ELSE 'routine' END AS tier FROM events GROUP BY 1 UNION ALL SELECT name, 0, tier FROM (VALUES ('Rumors', 'speculation'), (' trade ', 'speculation'), ('Injury', 'status'), ('official', 'confirmed'), ('Game', 'routine'), ('nonsense', 'routine')) t(name, tier)")
def chip_tiers(m):
    own = m.table("events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    more = m.spark.createDataFrame([(n, 0) for n in ("Rumors", " trade ", "Injury", "official", "Game", "nonsense")], "name string, n long")
    return own.unionByName(more).withColumn("tier", desk.tier(F.col("name")))


@query(f"""WITH {CLUSTERS}, t AS (SELECT '/player/' || entity_id AS path, count(*) AS n FROM clusters WHERE status = 'active' GROUP BY entity_id HAVING count(*) >= 10)
SELECT 'https://example.com' || path AS url, '2001-08-01' AS last_modified, 'daily' AS change_frequency, 0.7::DOUBLE AS priority FROM t UNION ALL
SELECT 'https://example.com' || p, CASE WHEN p = '/' THEN '2001-08-01' END, f, w::DOUBLE FROM (VALUES ('/', 'hourly', 1.0), ('/about', 'yearly', 0.5), ('/legal', 'yearly', 0.3), ('/submit', 'yearly', 0.4)) t(p, f, w)""")
def sitemap(m):
    topics = m.clusters().filter("status = 'active'").groupBy("entity_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("/player/"), F.col("entity_id").cast("string")).alias("path"), "n")
    return desk.sitemap(topics, "https://example.com", F.lit("2001-08-01"))


@query(f"WITH {CLUSTERS}, {ENTITIES} SELECT 'clusters' AS name, count(*) AS n, count(*) FILTER (WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS recent FROM clusters UNION ALL SELECT 'active', count(*) FILTER (WHERE status = 'active'), 0 FROM clusters UNION ALL SELECT 'items', count(*), count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) FROM lineitem UNION ALL SELECT 'entities', count(*), 0 FROM entities")
def store_status(m):
    cut = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    c, i = m.clusters(), m.table("lineitem")
    n = F.count("*").alias("n")
    parts = [
        c.agg(n, F.count_if(F.col("last_seen_at") >= cut).alias("recent")).select(F.lit("clusters").alias("name"), "n", "recent"), c.agg(F.count_if(F.col("status") == "active")).select(F.lit("active"), "*", F.lit(0).cast("long")),
        i.agg(n, F.count_if(F.col("l_shipdate") >= cut)).select(F.lit("items"), "*"), m.entities().agg(n).select(F.lit("entities"), "n", F.lit(0).cast("long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"WITH {SOURCES} SELECT id, name, category FROM sources WHERE status = 'approved' AND name <> 'Supplier#000000001' ORDER BY priority, id")
def public_sources(m):
    """The public list: approved, without the synthetic source of submissions, whitelisted fields alone."""
    return feed.public_sources(m.sources(), "Supplier#000000001")


_DOC = """'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Stories</title><link>https://example.com</link>' || string_agg('<item><title>' || headline || '</title><link>' || coalesce(url, 'https://example.com') || '</link><guid isPermaLink="false">' || id || '</guid><pubDate>' || strftime(last_seen_at, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>', '' ORDER BY last_seen_at DESC, id DESC) || '</channel></rss>'"""


@query(f"""WITH {CLUSTERS}, {VARIANTS}, top AS (SELECT cluster_id, arg_min(url, (-rank, -epoch_us(published_at), id)) AS url FROM variants GROUP BY 1), newest AS (SELECT * FROM clusters WHERE status = 'active' ORDER BY last_seen_at DESC, id DESC LIMIT 50)
SELECT {_DOC} AS document FROM newest LEFT JOIN top ON cluster_id = id""")
def rss_document(m):
    return feed.rss_document(m.clusters(), feed.top_variants(m.variants()), "https://example.com")


__all__ = ["day", "text"]

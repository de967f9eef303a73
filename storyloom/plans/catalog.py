"""The registered queries and their DuckDB equivalents, over the model's mapping of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import similarity, text, udfs, urls
from ..operators import classify, clustering, dedupe, evaluation, feed, maintenance
from ..schemas import SOURCE_CATEGORY, category_rank, ordinal
from ..streaming import jobs
from . import views
from .staging import stage_path, staged
from .views import AS_OF, CLUSTERS, ENTITIES, LOGS, RELATIONS, SOURCES, TITLES, VARIANTS, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Model under its name, with its SQL if it has one."""

    def of(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return of


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def strings(array: Column | str) -> Column:
    return F.array_join(array, "|")


# Feed pages.

_SINCE = "1998-01-01"
_PAGE = f"SELECT id, headline, strftime(last_seen_at, '%Y-%m-%d') AS last_seen_at FROM clusters c WHERE status = 'active' AND last_seen_at >= TIMESTAMP '{_SINCE}'"
_TAGGED = "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.id AND l.l_returnflag IN ('R', 'A'))"
_NAMED = "EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey = c.entity_id AND k.c_mktsegment = 'BUILDING')"
_ORDER = "ORDER BY c.last_seen_at DESC, id DESC LIMIT 51"


def _since() -> Column:
    return F.lit(_SINCE).cast("timestamp_ntz")


def _tagged(m: Model) -> DataFrame:
    return m.table("lineitem").filter(F.col("l_returnflag").isin("R", "A")).select(F.col("l_orderkey").alias("cluster_id"))


def _building(m: Model) -> DataFrame:
    named = m.table("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return m.table("orders").join(named, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("cluster_id"))


@query(f"WITH {CLUSTERS} {_PAGE} {_ORDER}")
def feed_page(m):
    return feed.page(m.clusters(), since=_since()).select("id", "headline", day("last_seen_at"))


@query(f"WITH {CLUSTERS} {_PAGE} AND (last_seen_at < TIMESTAMP '2000-03-01' OR (last_seen_at = TIMESTAMP '2000-03-01' AND id < 7000)) {_ORDER}")
def feed_page_after_cursor(m):
    cursor = (F.lit("2000-03-01").cast("timestamp_ntz"), 7000)
    return feed.page(m.clusters(), since=_since(), cursor=cursor).select("id", "headline", day("last_seen_at"))


@query(f"WITH {CLUSTERS} {_PAGE} AND {_TAGGED} AND {_NAMED} {_ORDER}")
def feed_any_tag_and_entity(m):
    return feed.page(m.clusters(), _tagged(m), _building(m), since=_since()).select("id", "headline", day("last_seen_at"))


@query(f"WITH {CLUSTERS} {_PAGE} AND false {_ORDER}")
def feed_unknown_slug_empty(m):
    """A slug that resolves to nothing gives an empty page, not an unfiltered one."""
    nothing = m.table("customer").filter("c_mktsegment = 'NO SUCH'").select(F.col("c_custkey").alias("cluster_id"))
    return feed.page(m.clusters(), entities=nothing, since=_since()).select("id", "headline", day("last_seen_at"))


_TOP = "top AS (SELECT cluster_id, id AS top_id, url FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rank DESC, published_at DESC, id) AS n FROM variants) WHERE n = 1)"


@query(f"WITH {VARIANTS}, {_TOP} SELECT * FROM top")
def top_variant_per_cluster(m):
    return feed.top_variants(m.variants())


def _sql_key(c: str) -> str:
    """A title for matching, for titles whose publisher's suffix begins with a capital and has no dot."""
    cut = f"regexp_replace({c}, '\\s+[-–—|]\\s+[A-Z][A-Za-z0-9]*\\s*$', '')"
    return f"trim(regexp_replace(regexp_replace(lower({cut}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_BEST = "rank DESC, published_at DESC, id"
_PREVIEWS = f"""keyed AS (SELECT v.*, {_sql_key('v.title')} AS key, {_sql_key('c.headline')} AS head FROM variants v JOIN clusters c ON v.cluster_id = c.id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY {_BEST}) AS k FROM keyed WHERE key <> '' AND key <> head) WHERE k = 1),
previews AS (SELECT cluster_id, string_agg(title, '|' ORDER BY n) AS headlines FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_BEST}) AS n FROM firsts) WHERE n <= 3 GROUP BY cluster_id)"""


@query(f"WITH {CLUSTERS}, {VARIANTS}, {_PREVIEWS} SELECT * FROM previews")
def variant_previews_top3(m):
    return feed.previews(m.variants(), m.clusters()).select("cluster_id", strings("headlines").alias("headlines"))


_RELATED = """ways AS (SELECT a AS cluster_id, b AS other, score FROM relations UNION ALL SELECT b, a, score FROM relations),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC NULLS LAST, other) AS n FROM ways) WHERE n <= 3)"""


@query(f"WITH {CLUSTERS}, {RELATIONS}, {_RELATED} SELECT cluster_id, other, headline, round(score, 6) AS score, CAST(n AS INTEGER) AS n FROM best JOIN clusters c ON other = c.id WHERE status = 'active'")
def related_top3_limit_then_filter(m):
    return feed.related(m.relations(), m.clusters()).withColumn("score", F.round("score", 6))


@query(f"""WITH {RELATIONS}, ends AS (SELECT a, b, score, a AS own FROM relations UNION ALL SELECT a, b, score, b FROM relations),
stale AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC NULLS LAST, a, b) AS n FROM ends) WHERE n > 5)
SELECT a, b, round(score, 6) AS score FROM relations r WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.a = r.a AND s.b = r.b)""")
def relations_pruned(m):
    return feed.strongest_relations(m.relations(), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {VARIANTS}, o AS (SELECT *, CASE category WHEN 'official' THEN 0 WHEN 'press' THEN 1 ELSE 2 END AS k FROM variants)
SELECT id, cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY k, published_at DESC, id) AS INTEGER) AS documented,
CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, published_at DESC, id) AS INTEGER) AS literal FROM o""")
def variants_by_category_recency(m):
    own = lambda literal: F.row_number().over(Window.partitionBy("cluster_id").orderBy(*feed.variant_order(literal)))
    return m.variants().select("id", "cluster_id", own(False).alias("documented"), own(True).alias("literal"))


@query(f"""WITH {CLUSTERS}, tags AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY 1)
SELECT id, headline, coalesce(tags, '') AS tags, coalesce(c_name, '') AS entities FROM clusters LEFT JOIN tags ON k = id LEFT JOIN customer ON c_custkey = entity_id WHERE status = 'active'""")
def feed_view(m):
    tags = m.table("lineitem").groupBy(F.col("l_orderkey").alias("cluster_id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("tags"))
    c = m.clusters().filter("status = 'active'")
    out = c.join(tags, c["id"] == tags["cluster_id"], "left").join(m.entities().withColumnRenamed("id", "_e").select("_e", "name"), F.col("entity_id") == F.col("_e"), "left")
    return out.select("id", "headline", F.coalesce(strings("tags"), F.lit("")).alias("tags"), F.coalesce("name", F.lit("")).alias("entities"))


@query(f"WITH {CLUSTERS}, {VARIANTS} SELECT c.id, headline, status, string_agg(v.url, '|' ORDER BY rank DESC, published_at DESC, v.id) AS variants, count(*) AS n FROM clusters c JOIN variants v ON v.cluster_id = c.id GROUP BY ALL")
def cluster_detail_view(m):
    ordered = F.array_sort(F.collect_list(F.struct((-category_rank("category")).alias("k"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("t"), F.col("id"), "url")))
    urls_of = m.variants().groupBy("cluster_id").agg(strings(F.transform(ordered, lambda s: s["url"])).alias("variants"), F.count("*").alias("n"))
    return m.clusters().join(urls_of, F.col("id") == F.col("cluster_id")).select("id", "headline", "status", "variants", "n")


@query(f"WITH {CLUSTERS}, {ENTITIES} SELECT entity_id, name, count(DISTINCT c.id) AS cluster_count FROM clusters c JOIN entities e ON e.id = entity_id WHERE status = 'active' GROUP BY ALL ORDER BY cluster_count DESC, name, entity_id LIMIT 20")
def entity_prominence(m):
    bridge = m.clusters().select(F.col("id").alias("cluster_id"), "entity_id")
    return feed.prominence(m.clusters().drop("entity_id"), bridge, m.entities())


@query(f"WITH {ENTITIES} SELECT id, name, entity_type FROM entities WHERE name ILIKE '%r#0000000_7%' ORDER BY name, id LIMIT 20")
def entity_search_ilike(m):
    return feed.search(m.entities(), "R#0000000_7")


@query(f"WITH {CLUSTERS} SELECT l_returnflag AS tag, count(DISTINCT id) AS cluster_count FROM clusters JOIN lineitem ON l_orderkey = id WHERE status = 'active' GROUP BY 1")
def tag_distribution(m):
    bridge = m.table("lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_returnflag").alias("tag")).distinct()
    return feed.tag_distribution(m.clusters(), bridge)


@query(f"WITH {CLUSTERS} SELECT count(*) AS n FROM clusters WHERE status = 'active' AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR")
def recent_cluster_count(m):
    cut = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 720 HOURS")
    return m.clusters().filter((F.col("status") == "active") & (F.col("last_seen_at") >= cut)).agg(F.count("*").alias("n"))


@query(f"""WITH {CLUSTERS}, v AS (SELECT l_orderkey, count(*) AS variants FROM lineitem GROUP BY 1)
SELECT id, headline, variants, round(CAST(epoch(last_seen_at - first_seen_at) AS DOUBLE) / 3600, 1) AS span_hours FROM clusters JOIN v ON l_orderkey = id
WHERE status = 'active' AND (variants >= 15 OR epoch(last_seen_at - first_seen_at) / 3600 >= 120) ORDER BY variants DESC, id LIMIT 20""")
def oversized_clusters(m):
    return feed.oversized(m.clusters(), m.table("lineitem").select(F.col("l_orderkey").alias("cluster_id")))


@query("SELECT l_orderkey AS cluster_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def multi_variant_clusters(m):
    return m.table("lineitem").groupBy(F.col("l_orderkey").alias("cluster_id")).agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""WITH {VARIANTS}, o AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, id) AS n FROM variants)
SELECT a.cluster_id, a.id AS a_id, b.id AS b_id FROM o a JOIN o b ON a.cluster_id = b.cluster_id AND a.n < b.n ORDER BY a.cluster_id, a.n, b.n LIMIT 400""")
def candidate_pairs(m):
    return evaluation.candidate_pairs(m.raw_variants())


@query(f"""WITH {SOURCES}, recent AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1)
SELECT id, name, category, status, CASE WHEN status = 'unsupported' THEN 'unsupported' WHEN status <> 'approved' THEN 'disabled' WHEN fetch_error_count >= 3 THEN 'broken' WHEN last_fetched_at IS NULL THEN 'unknown'
WHEN last_fetched_at < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR THEN 'stale' ELSE 'active' END AS health, coalesce(n, 0) AS recent_items_7d FROM sources LEFT JOIN recent ON l_suppkey = id""")
def source_health(m):
    return maintenance.health(m.sources(), m.table("lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("created_at")), AS_OF)


@query(f"""WITH {SOURCES}, a AS (SELECT max(last_fetched_at) AS last, count(*) FILTER (WHERE status = 'approved' AND fetch_error_count >= 3) AS broken_sources FROM sources)
SELECT strftime(last, '%Y-%m-%d %H:%M:%S') AS last_scan_at, coalesce(last < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE, true) AS ingest_stale, broken_sources, coalesce(last < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE, true) OR broken_sources > 0 AS degraded FROM a""")
def pipeline_health(m):
    return maintenance.pipeline_health(m.sources(), AS_OF)


_RATE = "round(100.0 * count(*) FILTER (WHERE result = 'error') / count(*), 2)"


@query(f"""WITH {LOGS} SELECT count(*) AS total, count(*) FILTER (WHERE result = 'approved') AS approved, count(*) FILTER (WHERE result = 'rejected') AS rejected, count(*) FILTER (WHERE result = 'error') AS errors,
count(*) FILTER (WHERE method = 'llm') AS llm, count(*) FILTER (WHERE method = 'keyword') AS keyword, count(*) FILTER (WHERE method = 'skip') AS skipped, CAST({_RATE} AS DOUBLE) AS error_rate, round(avg(latency) FILTER (WHERE method = 'llm'), 6) AS avg_latency FROM logs""")
def validation_stats(m):
    n = lambda c, v: F.count_if(F.col(c) == v)
    return m.logs().agg(
        F.count("*").alias("total"), n("result", "approved").alias("approved"), n("result", "rejected").alias("rejected"), n("result", "error").alias("errors"), n("method", "llm").alias("llm"), n("method", "keyword").alias("keyword"), n("method", "skip").alias("skipped"),
        F.round(F.lit(100.0).cast("double") * n("result", "error") / F.count("*"), 2).alias("error_rate"), F.round(F.avg(F.when(F.col("method") == "llm", F.col("latency"))), 6).alias("avg_latency"),
    )


@query(f"""WITH {LOGS}, k AS (SELECT * FROM logs WHERE llm_response IS NOT NULL AND keyword_matched IS NOT NULL)
SELECT count(*) AS total_compared, count(*) FILTER (WHERE approved = keyword_matched) AS agreements, count(*) FILTER (WHERE approved AND NOT keyword_matched) AS llm_more_permissive,
count(*) FILTER (WHERE NOT approved AND keyword_matched) AS llm_more_strict, round(CAST(100.0 * count(*) FILTER (WHERE approved = keyword_matched) / count(*) AS DOUBLE), 1) AS agreement_rate FROM k""")
def llm_keyword_agreement(m):
    k = m.logs().filter("llm_response IS NOT NULL AND keyword_matched IS NOT NULL").withColumn("approved", text.verdict(F.col("llm_response")))
    same, own = F.count_if(F.col("approved") == F.col("keyword_matched")), F.col("keyword_matched")
    return k.agg(
        F.count("*").alias("total_compared"), same.alias("agreements"), F.count_if(F.col("approved") & ~own).alias("llm_more_permissive"), F.count_if(~F.col("approved") & own).alias("llm_more_strict"),
        F.round(F.lit(100.0).cast("double") * same / F.count("*"), 1).alias("agreement_rate"),
    )


@query(f"""WITH {LOGS}, k AS (SELECT *, row_number() OVER (PARTITION BY approved ORDER BY created_at DESC, id) AS n FROM logs WHERE llm_response IS NOT NULL AND keyword_matched IS NOT NULL AND approved <> keyword_matched)
SELECT id, approved, method, result FROM k WHERE n <= 20""")
def llm_disagreements_top20(m):
    k = m.logs().filter("llm_response IS NOT NULL AND keyword_matched IS NOT NULL").withColumn("approved", text.verdict(F.col("llm_response"))).filter("approved <> keyword_matched")
    n = F.row_number().over(Window.partitionBy("approved").orderBy(F.desc("created_at"), "id"))
    return k.withColumn("n", n).filter("n <= 20").select("id", "approved", "method", "result")


@query("""WITH k AS (SELECT quality = 1 AS truth, length(text) > 500 AS guess FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE NOT truth AND guess) AS fp,
count(*) FILTER (WHERE truth AND NOT guess) AS fn, count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn FROM k) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM c""")
def pair_confusion(m):
    k = m.table("labels").join(m.table("documents"), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.length("text") > 500).alias("guess"))
    return k.agg(*classify.confusion(F.col("truth"), F.col("guess")))


@query(f"WITH {CLUSTERS}, {SOURCES} SELECT (SELECT sum(click_count) FROM clusters)::BIGINT AS page_views, (SELECT count(*) FROM clusters) AS total_stories, (SELECT count(*) FROM sources WHERE status = 'approved') AS approved_sources")
def site_stats(m):
    a = m.clusters().agg(F.sum("click_count").alias("page_views"), F.count("*").alias("total_stories"), F.lit(0).cast("long").alias("approved_sources"))
    b = m.sources().filter("status = 'approved'").agg(F.lit(0).cast("long"), F.lit(0).cast("long"), F.count("*"))
    return a.union(b).agg(*(F.sum(c).alias(c) for c in a.columns))


_TABLES = ["orders", "lineitem", "supplier", "customer", "events", "documents"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def status_counts(m):
    out = None
    for t in _TABLES:
        one = m.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {CLUSTERS} SELECT status, count(*) AS n FROM clusters GROUP BY 1")
def status_breakdown(m):
    return m.clusters().groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {CLUSTERS} SELECT id, strftime(first_seen_at, '%Y-%m-%d') AS first_seen_at FROM clusters c WHERE status = 'active' AND event_type <> '5-LOW' AND source_count >= 2
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.id AND l_returnflag = 'R') ORDER BY c.first_seen_at, id LIMIT 5""")
def eligible_posts(m):
    posted = m.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("cluster_id"))
    c = m.clusters().withColumn("event_type", F.when(F.col("event_type") == "5-LOW", "opinion").otherwise(F.col("event_type")))
    return feed.eligible_posts(c, posted).select("id", day("first_seen_at"))


@query(f"WITH {CLUSTERS} SELECT id, status FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.id)")
def orphan_clusters(m):
    c = m.clusters()
    return c.join(m.table("lineitem").select("l_orderkey"), c["id"] == F.col("l_orderkey"), "left_anti").select("id", "status")


@query("SELECT e.event_id AS post_id, o.o_orderkey AS cluster_id, coalesce(o.o_orderstatus, 'gone') AS status FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id * 3 WHERE e.event_type = 'purchase'")
def posts_left_join(m):
    e, o = m.table("events").filter("event_type = 'purchase'"), m.table("orders")
    return e.join(o, o["o_orderkey"] == e["event_id"] * 3, "left").select(F.col("event_id").alias("post_id"), F.col("o_orderkey").alias("cluster_id"), F.coalesce("o_orderstatus", F.lit("gone")).alias("status"))


_CUT = "2001-01-01"


@query(f"WITH {CLUSTERS} SELECT 'clusters' AS name, count(*) AS n FROM clusters WHERE last_seen_at >= TIMESTAMP '{_CUT}' UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{_CUT}'")
def retention_purge(m):
    cut = F.lit(_CUT).cast("timestamp_ntz")
    c, i = maintenance.surviving(m.clusters(), m.raw_variants().withColumnRenamed("published_at", "created_at"), cut, cut)
    return c.agg(F.lit("clusters").alias("name"), F.count("*").alias("n")).union(i.agg(F.lit("items"), F.count("*")))


@query(f"WITH {CLUSTERS}, {VARIANTS} SELECT v.id, v.cluster_id FROM variants v WHERE v.published_at >= TIMESTAMP '{_CUT}' AND EXISTS (SELECT 1 FROM clusters c WHERE c.id = v.cluster_id AND c.last_seen_at >= TIMESTAMP '{_CUT}')")
def cascade_survivors(m):
    cut = F.lit(_CUT).cast("timestamp_ntz")
    c, i = maintenance.surviving(m.clusters(), m.raw_variants().withColumn("created_at", F.col("published_at")), cut, cut)
    return maintenance.cascade(i, c, "cluster_id").select("id", "cluster_id")


@query(f"""WITH {CLUSTERS}, g AS (SELECT *, CASE WHEN id % 10 = 3 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = c.id - 1) THEN id - 1 ELSE id END AS k FROM clusters c), v AS (SELECT CASE WHEN l_orderkey % 10 = 3 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l_orderkey - 1) THEN l_orderkey - 1 ELSE l_orderkey END AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT g.k AS id, min(headline) FILTER (WHERE id = g.k) AS headline, strftime(min(first_seen_at), '%Y-%m-%d') AS first_seen_at, strftime(max(last_seen_at), '%Y-%m-%d') AS last_seen_at,
string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS tokens, CAST(coalesce(max(n), 0) AS INTEGER) AS source_count FROM g LEFT JOIN v ON v.k = g.k GROUP BY g.k""")
def merge_rewrite(m):
    c = m.clusters().withColumn("tokens", F.array("event_type")).withColumn("entities_agg", F.array("entity_id")).withColumn("llm_summary", F.lit(None).cast("string"))
    ids = c.select("id")
    groups = c.filter("id % 10 = 3").select(F.col("id").alias("source"), (F.col("id") - 1).alias("target")).join(ids, F.col("target") == ids["id"], "left_semi")
    out, _ = maintenance.merged(c, m.raw_variants(), groups)
    return out.select("id", "headline", day("first_seen_at"), day("last_seen_at"), strings("tokens").alias("tokens"), "source_count")


@query(f"""WITH {VARIANTS}, x AS (SELECT *, tag = 'R' AND count(*) FILTER (WHERE tag <> 'R') OVER (PARTITION BY cluster_id) > 0 AS moved FROM variants)
SELECT CASE WHEN moved THEN cluster_id + 1000000000 ELSE cluster_id END AS cluster_id, strftime(min(published_at), '%Y-%m-%d') AS first_seen_at, strftime(max(published_at), '%Y-%m-%d') AS last_seen_at, count(*) AS source_count FROM x GROUP BY 1""")
def split_rewrite(m):
    v = m.raw_variants()
    chosen = v.filter("tag = 'R'").select(F.col("id").alias("variant_id"), (F.col("cluster_id") + 1_000_000_000).alias("new_cluster"))
    return maintenance.recomputed(maintenance.split(v, chosen)).select("cluster_id", day("first_seen_at"), day("last_seen_at"), "source_count")


@query("""WITH a AS (SELECT DISTINCT lower(replace(c_name, '#', '-')) AS x FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT DISTINCT lower(replace(c_name, '#', '-')) AS y FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(x, y) AS slug, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON x = y""")
def roster_diff(m):
    named = m.entities().withColumn("slug", F.lower(F.replace("name", F.lit("#"), F.lit("-"))))
    return maintenance.roster_diff(named.filter("id % 3 <> 0"), named.filter("id % 4 <> 0"))


@query("SELECT n, p, n >= 20 AND n <= 120 AND (p IS NULL OR p <= 0 OR n >= p * 0.7) AS ok FROM (SELECT c_nationkey, count(*) AS n, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey * 4 END AS p FROM customer GROUP BY 1)")
def roster_plausible(m):
    k = m.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("p", F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey") * 4))
    return k.select("n", "p", maintenance.plausible_roster(F.col("n"), F.col("p")).alias("ok"))


@query(f"""WITH {LOGS}, a AS (SELECT id, created_at FROM logs WHERE result = 'error' ORDER BY created_at, id LIMIT 50), b AS (SELECT id, created_at FROM logs WHERE result = 'rejected' AND id NOT IN (SELECT id FROM a) ORDER BY created_at, id LIMIT 50),
c AS (SELECT id, created_at FROM logs WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY created_at, id LIMIT 50) SELECT id, 'error' AS stratum FROM a UNION ALL SELECT id, 'rejected' FROM b UNION ALL SELECT id, 'any' FROM c""")
def stratified_sample(m):
    strata = [("error", F.col("result") == "error"), ("rejected", F.col("result") == "rejected"), ("any", F.lit(True))]
    return maintenance.stratified(m.logs().select("id", "created_at", "result"), strata, 50).select("id", "stratum")


# Text.

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def _sql_words(c: str) -> str:
    return f"string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"


def _sql_tokens(c: str) -> str:
    return f"list_filter({_sql_words(c)}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w) OR w = 'gm')"


@query(f"WITH {TITLES} SELECT id, array_to_string({_sql_tokens('text')}, ' ') AS tokens FROM titles")
def tokens_normalized(m):
    return m.titles().select("id", F.array_join(text.tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


@query(f"WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' - ' || replace(p_brand, '#', '') AS title FROM part) SELECT id, {_sql_key('title')} AS key FROM t")
def title_normalized(m):
    title = F.concat_ws(" ", "p_name", "p_type", F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("")))
    return m.table("part").select(F.col("p_partkey").alias("id"), text.title_key(title).alias("key"))


@query("SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-') AS slug FROM (SELECT doc_id AS id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 140) AS title FROM documents)")
def slugs(m):
    return m.titles().select("id", text.slug(F.col("title")).alias("slug"))


@query("SELECT id, nullif(trim(substr(trim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), 1, 80), '-'), '') AS story_key FROM (SELECT doc_id AS id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 140) AS title FROM documents)")
def story_key_slug(m):
    return m.titles().select("id", text.story_key(F.col("title")).alias("story_key"))


def _title_pairs(m: Model) -> DataFrame:
    """Neighbouring titles of a source, by id: a blocked pair set."""
    w = Window.partitionBy("source").orderBy("id")
    return m.titles().withColumn("other", F.lead("title").over(w)).filter("other IS NOT NULL").select("id", F.col("title").alias("left"), F.col("other").alias("right"))


_PAIRS = f"{TITLES}, pairs AS (SELECT * FROM (SELECT id, title AS l, lead(title) OVER (PARTITION BY source ORDER BY id) AS r FROM titles) WHERE r IS NOT NULL)"
_SUFFIX = "'^(.*?)\\s+([-–—|])\\s+(.+?)\\s*$'"


def _sql_title_key(c: str) -> str:
    """The whole rule of a matching title: a suffix after a bar goes, and one of at most six words that have a capital or a dot."""
    cut = f"regexp_extract({c}, {_SUFFIX}, 1, 's')"
    label = f"regexp_extract_all(regexp_extract({c}, {_SUFFIX}, 3, 's'), '[A-Za-z0-9.]+')"
    named = f"len({label}) BETWEEN 1 AND 6 AND len(list_filter({label}, lambda w: NOT (contains(w, '.') OR regexp_matches(w, '[A-Z]')))) = 0"
    kept = f"CASE WHEN regexp_matches({c}, {_SUFFIX}, 's') AND (regexp_extract({c}, {_SUFFIX}, 2, 's') = '|' OR {named}) THEN {cut} ELSE {c} END"
    flat = f"trim(regexp_replace(regexp_replace(lower(replace(replace({kept}, '’', ''''), '‘', '''')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace({flat}, '\\bgeneral manager\\b', 'gm', 'g'))"


_LONG = lambda c: f"list_distinct(list_filter(string_split({_sql_title_key(c)}, ' '), lambda w: length(w) > 2 OR w = 'gm'))"


@query(f"""WITH {_PAIRS}, s AS (SELECT id, {_LONG('l')} AS a, {_LONG('r')} AS b FROM pairs), k AS (SELECT id, len(a) AS n, len(b) AS m, len(list_intersect(a, b)) AS i FROM s)
SELECT id, CAST(i AS INTEGER) AS shared, round(CASE WHEN n > 0 AND m > 0 THEN i / (n + m - i) ELSE 0 END, 6) AS jaccard, round(CASE WHEN least(n, m) > 0 THEN i / least(n, m) ELSE 0 END, 6) AS containment FROM k""")
def title_token_similarity(m):
    a, b = (text.title_tokens(text.title_key(F.col(c))) for c in ("left", "right"))
    return _title_pairs(m).select("id", similarity.shared(a, b).alias("shared"), F.round(similarity.jaccard(a, b), 6).alias("jaccard"), F.round(similarity.containment(a, b), 6).alias("containment"))


@query(f"""WITH {_PAIRS}, s AS (SELECT id, list_filter(list_distinct({_sql_tokens('l')}), lambda w: w NOT IN ('nhl', 'hockey', 'news', 'the')) AS a, list_filter(list_distinct({_sql_tokens('r')}), lambda w: w NOT IN ('nhl', 'hockey', 'news', 'the')) AS b FROM pairs)
SELECT id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS topic FROM s""")
def topic_similarity(m):
    strip = F.array(*map(F.lit, [*text.GENERIC, "the"]))
    return _title_pairs(m).select("id", F.round(similarity.topic(text.tokens(F.col("left")), text.tokens(F.col("right")), strip), 6).alias("topic"))


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list(l_partkey % 20)) AS a, list(l_suppkey % 20) AS b FROM lineitem GROUP BY 1)
SELECT id, round(len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(a), len(b)), 6) AS overlap FROM s""")
def entity_overlap(m):
    s = m.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey") % 20).alias("a"), F.collect_list(F.col("l_suppkey") % 20).alias("b"))
    return s.select("id", F.round(similarity.entity_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


_NAME_STOP = "[" + ", ".join(f"'{w}'" for w in text.NAME_STOPWORDS) + "]"


@query(f"""WITH {TITLES}, w AS (SELECT id, unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z''’.-]*')) AS word, generate_subscripts(regexp_extract_all(title, '[A-Za-z][A-Za-z''’.-]*'), 1) AS k FROM titles),
p AS (SELECT a.id, a.word AS x, b.word AS y FROM w a JOIN w b ON a.id = b.id AND b.k = a.k + 1),
n AS (SELECT id, trim(lower(x), '.') AS x, trim(lower(y), '.') AS y FROM p WHERE regexp_matches(x, '^[A-Z].*[a-z]') AND regexp_matches(y, '^[A-Z].*[a-z]'))
SELECT DISTINCT id, x || ' ' || y AS name FROM n WHERE NOT list_contains({_NAME_STOP}, x) AND NOT list_contains({_NAME_STOP}, y)""")
def person_name_keys(m):
    return m.titles().select("id", F.explode(text.name_keys(F.col("title"))).alias("name"))


def _stub_titles(m: Model) -> DataFrame:
    """Score-page titles made from the suppliers' numbers, and plain ones."""
    n = F.col("s_suppkey").cast("string")
    made = [F.concat(F.lit("Kings vs. Ducks - 2026-09-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" - TSN")), F.concat(F.lit("How to Watch game "), n), F.concat(F.lit("Kings beat Ducks "), n, F.lit(" - 2")), F.concat(F.lit("Oilers at Stars | Matchup | "), n), F.col("s_name")]
    return m.table("supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.array(*made)).alias("title"))


@query("""WITH t AS (SELECT s_suppkey AS id, unnest(['Kings vs. Ducks - 2026-09-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') || ' - TSN', 'How to Watch game ' || s_suppkey, 'Kings beat Ducks ' || s_suppkey || ' - 2', 'Oilers at Stars | Matchup | ' || s_suppkey, s_name]) AS title FROM supplier)
SELECT id, title, regexp_matches(lower(title), 'how to watch|[|] matchup [|]|^kings vs[.] ducks - 2026-09-[0-9]{2} - tsn$') AS stub FROM t""")
def stub_titles(m):
    return _stub_titles(m).select("id", "title", text.is_stub(F.col("title")).alias("stub"))


_SQL_STRIP = "trim(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), ' ')"


@query(f"SELECT page_id AS id, md5({_SQL_STRIP.format(c='html')}) AS digest, length({_SQL_STRIP.format(c='html')}) AS n FROM pages")
def html_stripped(m):
    out = text.strip_tags(F.col("html"))
    return m.table("pages").select(F.col("page_id").alias("id"), F.md5(out.cast("binary")).alias("digest"), F.length(out).cast("long").alias("n"))


@query(f"""WITH t AS (SELECT page_id AS id, trim(regexp_replace({_SQL_STRIP.format(c="regexp_extract(html, '<article>(.*)</article>', 1, 's')")}, '\\s+', ' ', 'g')) AS x FROM pages)
SELECT id, CASE WHEN x = '' THEN NULL WHEN length(x) <= 140 THEN x ELSE regexp_replace(substr(x, 1, 140), ' [^ ]*$', '') || '…' END AS title FROM t""")
def title_from_description(m):
    return m.table("pages").select(F.col("page_id").alias("id"), text.derived_title(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)).alias("title"))


# URLs and hashes.


@query("""WITH p AS (SELECT page_id AS id, regexp_extract(url, '^([^?#]*)', 1) AS base, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') AS q FROM pages),
k AS (SELECT id, base, array_to_string(list_filter(q, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_content|utm_term|ref|fbclid)=') AND NOT regexp_matches(x, '=$')), '&') AS q FROM p)
SELECT id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM k""")
def url_normalized(m):
    return m.table("pages").select(F.col("page_id").alias("id"), urls.canonical(F.col("url")).alias("canonical"))


@query("SELECT page_id AS id, regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM pages")
def url_domain(m):
    return m.table("pages").select(F.col("page_id").alias("id"), urls.domain(F.col("url")).alias("domain"))


@query("SELECT l_suppkey AS id, 'uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS key FROM (SELECT DISTINCT l_suppkey, md5(CAST(l_partkey % 7 AS VARCHAR)) AS h FROM lineitem)")
def syndication_key(m):
    h = F.md5((F.col("l_partkey") % 7).cast("string").cast("binary"))
    sub = lambda a, n: F.substring(h, a, n)
    url = F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/v/"), F.upper(sub(1, 8)), F.lit("-"), sub(9, 4), F.lit("-4"), sub(14, 3), F.lit("-a"), sub(18, 3), F.lit("-"), sub(21, 12), F.lit("/story?x=1"))
    return m.table("lineitem").select(F.col("l_suppkey").alias("id"), urls.syndication_key(url).alias("key")).distinct()


@query(f"WITH {TITLES} SELECT id, sha256(source || ':' || 'https://example.com/' || id || ':' || title) AS hash FROM titles")
def ingest_hash(m):
    return m.titles().select("id", urls.ingest_hash(F.col("source"), F.concat(F.lit("https://example.com/"), F.col("id").cast("string")), F.col("title")).alias("hash"))


@query()
def ingest_dedupe(m):
    return dedupe.greedy(m.items()).select("id", "source_id", "canonical_url")


# Classification, over a vocabulary of words that the test texts have.

VOCABULARY = {"trade": ["the", "that"], "injury": ["with", "from"], "lineup": ["der", "die"], "recall": ["les", "des"], "waiver": ["que", "los"], "signing": ["this", "are"], "prospect": ["une", "est"], "game": ["for", "was"], "opinion": ["not", "und"]}


def _sql_count(keys: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){k}([^\\p{{L}}\\p{{N}}_]|$)') AS INTEGER)" for k in keys)


_COUNTED = f"{TITLES}, counted AS (SELECT id, source, low, {', '.join(f'{_sql_count(v)} AS {k}' for k, v in VOCABULARY.items())} FROM (SELECT id, source, lower(title) AS low FROM titles))"
_TYPED = "CASE " + " ".join(f"WHEN {k} > 0 AND {k} = greatest({', '.join(VOCABULARY)}) THEN '{k}'" for k in VOCABULARY) + " ELSE 'other' END"


@query(f"WITH {_COUNTED} SELECT * EXCLUDE (source, low) FROM counted")
def event_keywords(m):
    return m.titles().select("id", *(n.alias(k) for k, n in classify.counts(F.col("title"), VOCABULARY)))


@query(f"WITH {_COUNTED} SELECT id, {_TYPED} AS event_type FROM counted")
def event_type(m):
    return m.titles().select("id", classify.event_type(F.col("title"), VOCABULARY).alias("event_type"))


@query(f"""WITH {_COUNTED} SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN {k} > 0 THEN '{k.capitalize()}' END" for k in VOCABULARY if k != 'opinion')}, CASE WHEN source IN ('src1', 'src4', 'src7') AND (contains(low, 'with ') OR contains(low, ' avec ') OR contains(low, 'ing the')) THEN 'Rumors' END], lambda x: x IS NOT NULL), '|') AS tags FROM counted""")
def tags_keyword(m):
    category = F.when(F.col("source").isin("src1", "src4", "src7"), "press").otherwise("other")
    return m.titles().select("id", strings(classify.tags(F.col("title"), category, VOCABULARY, ["with ", " avec ", "ing the"])).alias("tags"))


_NAMES = [(1, "The and"), (2, "Onre"), (3, "Le la"), (4, "Der die"), (5, "Anor thsteer"), (6, "Que los")]
_DICT = ", ".join(f"({i}, '{n.lower()}')" for i, n in _NAMES)
_EDGED = "'(^|[\\s,.:;!?''\"()])' || {} || '([\\s,.:;!?''\"()]|$)'"


@query(f"""WITH t AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS low FROM documents), d(entity_id, name) AS (VALUES {_DICT}),
terms AS (SELECT entity_id, name AS term, true AS "full" FROM d UNION ALL SELECT entity_id, split_part(name, ' ', -1), false FROM d WHERE contains(name, ' ') AND length(split_part(name, ' ', -1)) >= 5)
SELECT id, CAST(entity_id AS BIGINT) AS entity_id, bool_or("full") AS "full" FROM t JOIN terms ON regexp_matches(low, {_EDGED.format('term')}) AND ("full" OR contains(low, 'tion') OR contains(low, 'keit')) GROUP BY ALL""")
def dictionary_entities(m):
    """Names in whole texts; a last name counts where the text has a context keyword."""
    names = m.spark.createDataFrame(_NAMES, "id long, name string")
    return classify.entities(m.table("documents").select(F.col("doc_id").alias("id"), "text"), names, context=["tion", "keit"])


@query()
def gestalt_title_pairs(m):
    scored = clustering.pair_scores(_title_pairs(m))
    return scored.select("id", "jaccard", F.round(udfs.gestalt(F.col("left_key"), F.col("right_key")), 6).alias("ratio"))


def _articles(m: Model) -> tuple[DataFrame, DataFrame]:
    """Documents as articles: two an hour, with their whole texts; entities by frequent words, event types by
    vocabulary, a shared syndication id on some, summaries and story keys on others."""
    t = m.titles()
    names = m.spark.createDataFrame([(1, "Onre", "player"), (2, "Thti", "player"), (3, "Team", "team")], "id long, name string, entity_type string")
    own = F.filter(F.array(*(F.when(F.lower("title").contains(n), F.lit(k).cast("long")) for k, n in ((1, "onre"), (2, "thti"), (3, "the")))), lambda x: x.isNotNull())
    at = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 2) * 3600)
    h = F.md5(F.floor(F.col("id") / 40).cast("string").cast("binary"))
    shared = F.concat(F.lit("https://x.example.com/"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    url = F.when(F.col("id") % 20 == 7, shared).otherwise(F.concat(F.lit("https://x.example.com/"), F.col("id").cast("string")))
    summary = F.when((F.col("id") % 4 == 0) & (F.length("title") > 20), F.substring("title", 1, 90))
    key = F.when(F.col("id") % 6 == 0, text.story_key(F.substring_index("title", " ", 3)))
    category = F.when(F.col("id") % 9 == 0, "official").when(F.col("id") % 2 == 0, "press").otherwise("other")
    return t.select("id", F.col("id").alias("arrival"), url.alias("url"), "title", "text", at.alias("published_at"), classify.event_type(F.col("title"), VOCABULARY).alias("event_type"), category.alias("category"), own.alias("entities"), summary.alias("llm_summary"), key.alias("story_key"), "source"), names


def _assigned(m: Model) -> DataFrame:
    return clustering.assign(clustering.features(*_articles(m)))


@query()
def story_clusters(m):
    return _assigned(m).filter("kind = 'story'").select("id", "headline", "event_type", "source_count", day("first_seen_at"), day("last_seen_at"))


@query()
def story_relations(m):
    return _assigned(m).filter("kind = 'relation'").select(F.col("id").alias("a"), F.col("other").alias("b"), "score")


@query()
def decision_routes(m):
    return _assigned(m).filter("kind = 'member'").groupBy("route").agg(F.count("*").alias("n"))


# Streams.


@query("SELECT user_id, strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def window_rate_limit_tumbling(m):
    return feed.rate_windows(m.table("events"), limit=1).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS trailing FROM events")
def rate_limit_trailing(m):
    return feed.trailing_counts(m.table("events")).select("event_id", "user_id", "trailing")


_ALERTS = """WITH RECURSIVE e AS (SELECT event_type AS condition, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
r AS (SELECT condition, t, n, t AS held, true AS fired FROM e WHERE n = 1 UNION ALL SELECT e.condition, e.t, e.n, CASE WHEN e.t - r.held >= 21600000000 THEN e.t ELSE r.held END, e.t - r.held >= 21600000000 FROM r JOIN e ON e.condition = r.condition AND e.n = r.n + 1)
SELECT condition, t AS "at" FROM r WHERE fired"""


@query(_ALERTS)
def alert_dedupe(m):
    return jobs.alerts_batch(m.table("events").select(F.col("event_type").alias("condition"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))


def _streamed(m: Model, table: str, build, mode: str, name: str) -> DataFrame:
    """Runs a stream over the table's files to its end; state, log and result are in the shared folder.

    ``append`` goes through the exactly-once file sink; in ``complete`` mode each batch replaces the table.
    """
    folder = stage_path(m.spark, f"stream-{name}")
    out = f"{folder}/out"
    built = build(m.spark.readStream.schema(m.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(m.sf_dir))
    sink = built.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    if mode == "append":
        sink = sink.format("parquet").option("path", out)
    else:
        sink = sink.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(out))
    jobs.run(sink.start())
    return m.spark.read.schema(built.schema).parquet(out)


@query("SELECT event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18, 2))), 2)::DOUBLE AS total FROM events GROUP BY 1")
def stream_counts_equal_batch(m):
    return _streamed(m, "events", jobs.counted, "complete", "counts")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedupe(m):
    return _streamed(m, "events", lambda s: s.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append", "dedupe").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query()
def stream_clusters_equal_batch(m):
    """Stories of each source as keyed state, fed in four slices by arrival, beside those of the batch fold.

    The stream stops after every slice and goes on from its log and state in the shared folder.
    """
    featured = staged(clustering.features(*_articles(m), keep=("source",)), "stream-articles")
    folder = stage_path(m.spark, "stream-stories")
    edges = [None, *featured.approxQuantile("arrival", [0.25, 0.5, 0.75], 0.01), None]
    for low, high in zip(edges, edges[1:], strict=False):
        own = featured
        own = own if low is None else own.filter(F.col("arrival") > low)
        own = own if high is None else own.filter(F.col("arrival") <= high)
        own.write.mode("append").parquet(f"{folder}/in")
        placed = jobs.stories(jobs.file_stream(m.spark, f"{folder}/in", featured.schema, files=1_000), "source")
        sink = placed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        jobs.run(sink.trigger(availableNow=True).start())
    streamed = m.spark.read.schema(placed.schema).parquet(f"{folder}/out")
    batch = clustering.assign(featured, group="source").filter("kind = 'member'").select("id", F.col("other").alias("batch_id"))
    return streamed.join(batch, "id", "full").select("id", "cluster_id", "route", F.col("cluster_id").eqNullSafe(F.col("batch_id")).alias("same"))


@query(f"WITH {SOURCES} SELECT category, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM sources WHERE status = 'approved' GROUP BY 1")
def sources_by_category(m):
    own = m.sources().filter("status = 'approved'").groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    return own.orderBy(ordinal("category", SOURCE_CATEGORY)).select("category", "n", strings("names").alias("names"))


@query(f"WITH {SOURCES} SELECT id, name, category, priority FROM sources WHERE status = 'approved' ORDER BY priority, id")
def active_sources(m):
    return m.sources().filter("status = 'approved'").orderBy("priority", "id").select("id", "name", "category", "priority")


@query(f"WITH {CLUSTERS} SELECT entity_id, count(*) AS n FROM clusters WHERE status = 'active' AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2000 DAY GROUP BY 1 HAVING count(*) >= 6")
def topic_pages(m):
    cut = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 2000 DAYS")
    return m.clusters().filter((F.col("status") == "active") & (F.col("last_seen_at") >= cut)).groupBy("entity_id").agg(F.count("*").alias("n")).filter("n >= 6")


@query(f"WITH {CLUSTERS} SELECT id, click_count >= 5 AS trending, greatest(source_count - 1, 0) AS more FROM clusters WHERE status = 'active'")
def card_flags(m):
    return m.clusters().filter("status = 'active'").select("id", (F.col("click_count") >= 5).alias("trending"), F.greatest(F.col("source_count") - 1, F.lit(0)).alias("more"))


@query(f"WITH {LOGS} SELECT id, method, result, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM logs WHERE result = 'rejected' ORDER BY logs.created_at DESC, id LIMIT 50 OFFSET 100")
def validations_page(m):
    return m.logs().filter("result = 'rejected'").orderBy(F.desc("created_at"), "id").offset(100).limit(50).select("id", "method", "result", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'trade' WHEN 1 THEN 'signing' WHEN 2 THEN 'game' ELSE 'other' END AS a, CASE o_custkey % 3 WHEN 0 THEN 'signing' WHEN 1 THEN 'lineup' ELSE 'other' END AS b, (o_orderkey % 11) / 10.0 AS e, (o_custkey % 13) / 12.0 AS t, (o_orderkey % 7) / 6.0 AS l, o_custkey % 2 = 0 AS c FROM orders),
k AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN a || '-' || b IN ('trade-signing', 'signing-other', 'game-lineup', 'other-signing') THEN 0.5 ELSE 0.0 END AS k FROM t)
SELECT id, CAST(k AS DOUBLE) AS k, round(CAST(CASE WHEN id % 3 = 0 AND c THEN 0.55 * e + 0.35 * t + 0.10 * k WHEN id % 3 = 0 THEN (0.35 * t + 0.10 * k) / 0.45 WHEN id % 3 = 1 AND c THEN 0.45 * e + 0.25 * t + 0.10 * k + 0.20 * l
WHEN id % 3 = 1 THEN 0.55 * t + 0.15 * k + 0.30 * l WHEN c THEN 0.35 * e + 0.20 * t + 0.10 * k + 0.35 * l ELSE 0.30 * t + 0.10 * k + 0.60 * l END AS DOUBLE), 6) AS score FROM k""")
def score_components(m):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.when(o % 4 == 0, "trade").when(o % 4 == 1, "signing").when(o % 4 == 2, "game").otherwise("other")
    b = F.when(c % 3 == 0, "signing").when(c % 3 == 1, "lineup").otherwise("other")
    k = similarity.event_compatibility(a, b)
    s = similarity.score((o % 11) / F.lit(10.0).cast("double"), (c % 13) / F.lit(12.0).cast("double"), k, (o % 7) / F.lit(6.0).cast("double"), c % 2 == 0, F.when(o % 3 == 0, "none").when(o % 3 == 1, "summary_headline").otherwise("summary_pair"))
    return m.table("orders").select(o.alias("id"), k.alias("k"), F.round(s, 6).alias("score"))


__all__ = ["ORACLE_SQL", "QUERIES", "views"]

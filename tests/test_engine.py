import datetime
import io
import contextlib

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import classify, feed, maintenance
from storyloom.plans import catalog
from storyloom.plans.views import Model
from storyloom.sources import feeds
from storyloom.streaming import jobs

from conftest import DATA


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_feed_plan(spark):
    got = plan(catalog.QUERIES["feed_any_tag_and_entity"](spark, DATA))
    assert "LeftSemi" in got and "TakeOrderedAndProject" in got and "GreaterThanOrEqual(o_orderdate" in got and "CartesianProduct" not in got


def test_limits_become_group_limits(spark):
    m = Model(spark, DATA)
    assert "WindowGroupLimit" in plan(feed.related(m.relations(), m.clusters()))


def test_keyset_walk_meets_every_cluster_once(spark):
    clusters = Model(spark, DATA).clusters()
    seen, cursor = [], None
    for _ in range(4):
        rows = feed.page(clusters, cursor=cursor, limit=20).collect()
        seen += [r["id"] for r in rows[:20]]
        cursor = (F.lit(rows[19]["last_seen_at"]), rows[19]["id"])
    assert len(set(seen)) == 80
    assert seen == [r["id"] for r in feed.page(clusters, limit=79).collect()]


def test_cursor_and_since():
    at = datetime.datetime(2024, 5, 1, 3, tzinfo=datetime.timezone.utc)
    assert feed.decode_cursor(feed.encode_cursor(at, 7)) == (at, 7)
    assert feed.decode_cursor("17") is None and feed.decode_cursor(None) is None and feed.decode_cursor("%%%") is None
    assert feed.since("24h", at) == at - datetime.timedelta(hours=24) and feed.since(None, at) is None
    with pytest.raises(ValueError):
        feed.since("xh", at)


@pytest.mark.parametrize(
    ("title", "event", "tags"),
    [("Sharks trade winger, sign goalie", "trade", ["Trade", "Signing"]), ("Assistant coach speaks", "other", []), ("Why they should think", "opinion", []), ("Out indefinitely with injury", "injury", ["Injury"]), ("Reportedly in talks", "other", ["Rumors"])],
)
def test_events_and_tags(spark, title, event, tags):
    row = spark.createDataFrame([(title,)], "t string").select(classify.event_type(F.col("t")).alias("e"), classify.tags(F.col("t"), F.lit("press")).alias("g")).first()
    assert row["e"] == event and row["g"] == tags


def test_source_tags_and_decision(spark):
    row = spark.range(1).select(
        classify.article_tags(F.lit("Barracuda win game"), F.lit(""), F.lit("official"), F.lit(None).cast("array<string>")).alias("a"),
        classify.decision("decision", F.lit(True), F.lit(False), F.lit(False)).alias("model"), classify.decision("decision", F.lit(True), F.lit(False), F.lit(True)).alias("failed"),
        classify.decision("evaluation", F.lit(True), F.lit(False), F.lit(False)).alias("evaluated"), classify.relevant(F.lit("News at SAP Center"), F.array().cast("array<long>")).alias("r"),
    ).first()
    assert row["a"] == ["Game", "Official", "Barracuda"] and (row["model"], row["failed"], row["evaluated"], row["r"]) == (False, True, True, True)


def test_entities(spark):
    items = spark.createDataFrame([(1, "Stuart Skinner starts, Skinner out for the Sharks"), (2, "Skinner in a junior recap"), (3, "panarin-skinner-slug sharks"), (4, "Will Smith, (Smith)"), (5, None)], "id long, text string")
    names = spark.createDataFrame([(10, "Jeff Skinner"), (11, "Stuart Skinner"), (12, "Will Smith"), (13, "12345")], "id long, name string")
    got = {(r["id"], r["entity_id"]): r["full"] for r in classify.entities(items, names).collect()}
    assert got == {(1, 10): False, (1, 11): True, (4, 12): True}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_entities_shuffle_no_text_per_word(spark, monkeypatch, limit):
    monkeypatch.setattr(classify, "BROADCAST", limit)
    items = spark.createDataFrame([(1, "Stuart Skinner starts, Skinner out for the Sharks"), (2, "Skinner in a junior recap"), (4, "Will Smith, (Smith)"), (5, None)], "id long, text string")
    names = spark.createDataFrame([(10, "Jeff Skinner"), (11, "Stuart Skinner"), (12, "Will Smith")], "id long, name string")
    found = classify.entities(items, names)
    assert {(r["id"], r["entity_id"]): r["full"] for r in found.collect()} == {(1, 10): False, (1, 11): True, (4, 12): True}

    def nodes(p):
        below = p.children()
        return [p, *(x for k in range(below.size()) for x in nodes(below.apply(k)))]

    dealt = [p for p in nodes(found._jdf.queryExecution().executedPlan().initialPlan()) if p.nodeName() == "Exchange"]
    texts = [p for p in dealt if "low#" in p.output().toString()]
    assert dealt and len(texts) == (limit == 0) and not any(x.nodeName() == "Generate" for p in texts for x in nodes(p))


def test_rewrites(spark):
    log = spark.createDataFrame([("a", "add", 1, 1), ("a", "set", 10, 2), ("a", "add", 2, 3), ("b", "add", 5, 1)], "key string, op string, value long, at long")
    assert {r["key"]: r["value"] for r in maintenance.counters(log).collect()} == {"a": 12, "b": 5}
    child, parent = spark.createDataFrame([(1, 5), (2, 6)], "id long, p long"), spark.createDataFrame([(5,)], "id long")
    assert [r["id"] for r in maintenance.cascade(child, parent, "p").collect()] == [1]
    assert {r["id"]: r["p"] for r in maintenance.cleared(child, parent, "p").collect()} == {1: 5, 2: None}
    items = spark.createDataFrame([(1, "Box score of the day", None), (2, "A real story", None), (3, "Live stream here", True)], "id long, raw_title string, ingest_stub boolean")
    variants = spark.createDataFrame([(1, 1, 7), (2, 2, 8)], "id long, raw_item_id long, cluster_id long")
    clusters = spark.createDataFrame([(7,), (8,), (9,)], "id long")
    kept, left, stories = maintenance.without_stubs(items, variants, clusters, F.col("ingest_stub"))
    assert (sorted(r["id"] for r in kept.collect()), [r["id"] for r in left.collect()], [r["id"] for r in stories.collect()]) == ([2, 3], [2], [8])
    people, bridge = maintenance.without_bogus(spark.createDataFrame([(1, "12"), (2, "Al")], "id long, name string"), spark.createDataFrame([(1,), (2,)], "entity_id long"))
    assert people.count() == bridge.count() == 1
    current = spark.createDataFrame([("a", "A", {"s": "1"})], "slug string, name string, metadata map<string,string>")
    more = spark.createDataFrame([("a", "AA", {}), ("b", "B", {"s": "2"})], current.schema)
    assert {r["slug"]: (r["name"], r["metadata"]) for r in maintenance.upserted(current, more).collect()} == {"a": ("A", {"s": "1"}), "b": ("B", {"s": "2"})}
    whole = maintenance.split(spark.createDataFrame([(1, 7), (2, 7)], "id long, cluster_id long"), spark.createDataFrame([(1, 70), (2, 70)], "variant_id long, new_cluster long"))
    assert {r["cluster_id"] for r in whole.collect()} == {7}


def test_feed_documents(spark):
    xml = b"""<rss><channel><title>c</title><link>https://pub.com/</link><item><title>A &nbsp; &amp; B <![CDATA[<b>x</b>]]></title><link>/rel/1</link><guid>g1</guid><pubDate>Sat, 10 Jan 2026 12:00:00 +0000</pubDate></item>
    <item><link>https://z.com/2</link><description>&lt;p&gt;Only a description\x07&lt;/p&gt;</description></item></channel></rss>"""
    landed = spark.createDataFrame([(1, bytearray(xml))], "source_id long, content binary")
    sources = spark.createDataFrame([(1, "https://base.com")], "id long, base_url string")
    a, b = feeds.entries(landed, sources).orderBy("position").collect()
    assert a["original_url"] == "https://pub.com/rel/1" and a["raw_title"].startswith("A") and a["raw_title"].endswith("& B x") and a["published_at"] == datetime.datetime(2026, 1, 10, 12)
    assert b["raw_title"] == "Only a description" and b["source_item_id"] == "https://z.com/2"
    latin = spark.createDataFrame([(bytearray("é".encode("latin-1")),)], "c binary")
    assert latin.select(feeds.repaired(F.col("c"))).first()[0] == "é"


def test_source_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("name,url,category,tier,ingest_method,feed_url,notes\n One ,https://one.com,Press,1,rss,,hi\nTwo,https://two.com,weird,9,carrier,https://two.com/rss,\n,https://x.com,press,1,rss,,\nOne,https://again.com,press,2,rss,,\nOld,https://old.com,press,2,rss,,\n")
    got = {r["name"]: (r["base_url"], r["category"], r["ingest_method"], r["priority"]) for r in feeds.source_list(spark, str(path), spark.createDataFrame([("Old",)], "name string")).collect()}
    assert got == {"One": ("https://one.com", "press", "rss", 10), "Two": ("https://two.com", "other", "rss", 100)}


def test_page_rules(spark):
    html = '<head><link rel="alternate" type="application/rss+xml" href="/f.xml"><meta name="date" content="2024-02-01"><meta property="article:published_time" content="2024-01-01"></head><time datetime="2023-01-01">'
    row = spark.createDataFrame([(html,)], "h string").select(feeds.page_date(F.col("h")).alias("d"), feeds.feed_links(F.col("h"), F.lit("https://e.com/")).alias("l"), feeds.feed_links(F.lit(""), F.lit("https://e.com/")).alias("u"), feeds.wrapped_article(F.lit("https://w.com/articles/42/x")).alias("w")).first()
    assert row["d"] == "2024-01-01" and row["l"] == ["/f.xml"] and row["u"][0] == "https://e.com/feed" and row["w"] == "42"
    page = "<h2>Forwards</h2><a>Last, First</a><a>Solo</a><a>Last, First</a><h2>End</h2><a>No</a>"
    assert spark.range(1).select(feeds.roster(F.lit(page), "Forwards", "End")).first()[0] == ["First Last", "Solo"]


def test_stories_as_stream_equal_batch(spark, tmp_path):
    from storyloom.operators import clustering

    articles, names = catalog._articles(Model(spark, DATA))
    featured = clustering.features(articles, names).withColumn("domain", F.lit("all"))
    featured.orderBy("arrival").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "in"))
    stream = jobs.stories(jobs.file_stream(spark, str(tmp_path / "in"), featured.schema, files=1), "domain")
    jobs.run(stream.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    streamed = {r["id"]: r["cluster_id"] for r in spark.table("told").collect()}
    batch = {r["id"]: r["other"] for r in clustering.assign(featured, group="domain").filter("kind = 'member'").collect()}
    assert streamed == batch and len(batch) == 200


def test_alerts_as_stream_equal_batch(spark, tmp_path):
    rows = Model(spark, DATA).table("events").select(F.col("event_type").alias("condition"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows.coalesce(1).sortWithinPartitions("at").write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    out = jobs.alerts(jobs.file_stream(spark, str(tmp_path / "in"), rows.schema, files=1))
    jobs.run(out.writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert sorted(map(tuple, spark.table("fired").collect())) == sorted(map(tuple, jobs.alerts_batch(rows).collect()))


def test_deduped_sink_replays(spark, tmp_path):
    items = Model(spark, DATA).items()
    sink = jobs.deduped_sink(f"file://{tmp_path}/history")
    for _ in range(2):
        sink(items, 0)
    kept = spark.read.parquet(f"file://{tmp_path}/history")
    assert kept.count() == catalog.QUERIES["ingest_dedupe"](spark, DATA).count()


def test_unicode_words_do_not_depend_on_the_jvm(spark):
    assert spark.range(1).select(text.tokens(F.lit("Éric's naïve café"))).first()[0] == ["éric", "naïve", "café"]


def test_relations_of_a_hub_at_both_ends(spark):
    """Cluster 2 is one end of every relation, and keeps its strongest whichever end it is."""
    rel = spark.createDataFrame([(0, 2, 0.95), (2, 3, 0.8), (1, 2, 0.9), (2, 4, 0.85), (3, 4, 0.1)], "a long, b long, score double")
    kept = lambda n: {(r["a"], r["b"]) for r in feed.strongest_relations(rel, n).collect()}
    assert kept(1) == {(0, 2)} and kept(2) == {(0, 2), (1, 2), (3, 4)} and len(kept(5)) == 5


def test_alerts_of_stretches_equal_one_pass(spark):
    import random

    rng, hour = random.Random(3), jobs.HOUR
    rows = [(c, int(t)) for c in "ab" for t in [rng.randrange(0, 400) * hour // 2 for _ in range(80)]] + [("c", 0)] * 3
    want = set()
    for c in "abc":
        last = None
        for t in sorted(t for x, t in rows if x == c):
            if last is None or t - last >= 6 * hour:
                want.add((c, t))
                last = t
    got = [tuple(r) for r in jobs.alerts_batch(spark.createDataFrame(rows, "condition string, at long")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_atom_and_other_dialects(spark):
    atom = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><link rel="self" href="https://x.com/feed"/><link href="https://x.com/"/>
    <entry><title type="html">One &amp;amp; two</title><link rel="enclosure" href="https://x.com/a.mp3"/><link rel="alternate" href="/one"/><id>urn:1</id><updated>2024-05-02T10:00:00Z</updated><published>2024-05-01T10:00:00Z</published><summary>About it</summary></entry>
    <entry><title></title><link href="https://y.com/two"/><id>urn:2</id><updated>2024-05-03T10:00:00+02:00</updated><content>&lt;p&gt;Only content here&lt;/p&gt;</content></entry></feed>"""
    rdf = """<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>C</title><link>https://z.com</link></channel><item><title>Old one</title><link>https://z.com/1</link><dc:date>2024-01-01T00:00:00Z</dc:date></item></rdf:RDF>"""
    encoded = """<rss xmlns:content="c"><channel><link>https://w.com</link><item><title>E</title><link>/e</link><content:encoded>Whole text</content:encoded><guid>g</guid><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item></channel></rss>"""
    landed = spark.createDataFrame([(1, bytearray(atom.encode())), (2, bytearray(rdf.encode())), (3, bytearray(encoded.encode()))], "source_id long, content binary")
    sources = spark.createDataFrame([(k, "https://base.com") for k in (1, 2, 3)], "id long, base_url string")
    got = sorted((r["source_id"], r["position"], r["original_url"], r["raw_title"], r["raw_description"], r["source_item_id"], r["published_at"].strftime("%Y-%m-%d %H")) for r in feeds.entries(landed, sources).collect())
    assert got == [
        (1, 0, "https://x.com/one", "One & two", "About it", "urn:1", "2024-05-01 10"), (1, 1, "https://y.com/two", "Only content here", "<p>Only content here</p>", "urn:2", "2024-05-03 08"),
        (2, 0, "https://z.com/1", "Old one", "", "https://z.com/1", "2024-01-01 00"), (3, 0, "https://w.com/e", "E", "Whole text", "g", "2024-05-01 10"),
    ]

"""Desk operators that SQL alone does not hold."""

import datetime
import json
import random

from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import desk, maintenance

import pytest


def test_accepted_against_a_loop(spark):
    rng = random.Random(2)
    base = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice("abc"), base + datetime.timedelta(minutes=rng.randrange(0, 3000))) for k in range(600)]
    got = {r["n"]: r["accepted"] for r in desk.accepted(spark.createDataFrame(rows, "n int, ip string, at timestamp"), "ip", "at", 3).collect()}
    for ip in "abc":
        held, count = [], 0
        for at in sorted(t for _, i, t in rows if i == ip):
            held = [x for x in held if x > at - datetime.timedelta(hours=1)]
            if len(held) < 3:
                held.append(at)
                count += 1
        assert count == sum(got[n] for n, i, _ in rows if i == ip)
    assert len(got) == len(rows) and 0 < sum(got.values()) < len(rows)


def test_retries_and_schedule(spark):
    frame = spark.createDataFrame([(429, 90, 0), (429, None, 0), (503, None, 0), (503, None, 1), (404, None, 0)], "s int, h int, a int")
    assert [r[0] for r in frame.select(desk.retry_after(F.col("s"), F.col("h"), F.col("a"))).collect()] == [30, 1, 1, None, None]
    assert [r[0] for r in spark.range(4).select(desk.backoff(F.col("id"))).collect()] == [60, 120, 240, None]
    at = datetime.datetime(2024, 1, 2)
    runs = spark.createDataFrame([("ingest", at - datetime.timedelta(minutes=9)), ("posts", at - datetime.timedelta(minutes=15)), ("posts", at - datetime.timedelta(days=2)), ("odd", at)], "job string, at timestamp")
    assert {r["job"] for r in desk.due(runs, F.lit(at)).collect()} == set(desk.SCHEDULE) - {"ingest"}
    with pytest.raises(ValueError):
        desk.checked("nonsense", ["a"])


def test_corpus_files(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 10, 11)], "cluster_id long, a_id long, b_id long")
    desk.write_corpus(spark.range(3), pairs, f"file://{tmp_path}/corpus")
    read = lambda d: [json.loads(x) for f in sorted((tmp_path / "corpus" / d).glob("*.json")) for x in f.read_text().splitlines()]
    assert sorted(r["id"] for r in read("items")) == [0, 1, 2]
    assert read("pairs") == [{"cluster_id": 1, "a_id": 10, "b_id": 11, "should_merge": None, "label_source": "unlabelled"}]


def test_reset_order(spark):
    one = spark.range(2)
    order = desk.emptied({"clusters": one, "members": one, "variants": one}, {"clusters": ["members"], "variants": ["members"]})
    assert [n for n, _ in order] == ["members", "clusters", "variants"] and all(f.isEmpty() for _, f in order)


def test_page_fields(spark):
    html = '<html><head><title>Plain &amp; title</title><meta name="author" content="A. Writer"><meta property="og:description" content="About it"></head><body><article><script>x</script><p>One <b>two</b></p></article></body></html>'
    rows = spark.createDataFrame([(html,), ('<meta property="og:title" content="Declared"><title>x</title>',), ("",), (None,)], "h string").select(*desk.page_fields(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("Plain & title", "About it", "A. Writer", "One two"), ("Declared", None, None, None), (None,) * 4, (None,) * 4]


def test_split_parts(spark):
    bridge = spark.createDataFrame([(1, "Trade"), (1, "Game"), (2, "Injury")], "cluster_id long, tag string")
    moved = spark.createDataFrame([(5, 1, 9), (6, 1, 9)], "variant_id long, cluster_id long, new_cluster long")
    assert sorted(map(tuple, maintenance.carried_tags(bridge, moved).collect())) == [(1, "Game"), (1, "Trade"), (2, "Injury"), (9, "Game"), (9, "Trade")]
    members = spark.createDataFrame([(5, 1), (7, 2)], "id long, cluster_id long")
    assert [r["variant_id"] for r in maintenance.unknown_members(members, moved.select("variant_id", "cluster_id")).collect()] == [6]
    rows = [(1, 1, "press", "Untitled", 1), (2, 1, "other", "Good one", 2), (3, 2, "other", None, 3)]
    frame = spark.createDataFrame(rows, "id long, cluster_id long, category string, title string, d int").select("id", "cluster_id", "category", "title", F.lit("2024-01-01").cast("timestamp_ntz").alias("published_at"), F.array("category").alias("tokens"), F.array("d").alias("entities"))
    got = {r["cluster_id"]: (r["headline"], r["tokens"], r["entities"], r["source_count"]) for r in maintenance.rebuilt(frame).collect()}
    assert got == {1: ("Good one", ["other", "press"], [1, 2], 2), 2: ("Untitled", ["other"], [3], 1)}


def test_outbox(spark):
    at = datetime.datetime(2024, 1, 1, 12)
    stories = spark.createDataFrame([(1, at), (2, at - datetime.timedelta(hours=1)), (3, at - datetime.timedelta(hours=2))], "id long, first_seen_at timestamp")
    posts = spark.createDataFrame([(3, "posted", 0, at - datetime.timedelta(minutes=10)), (2, "failed", 3, None)], "cluster_id long, status string, retry_count int, posted_at timestamp")
    assert [r["id"] for r in desk.next_post(stories, posts, F.lit(at)).collect()] == [1]
    assert desk.next_post(stories, posts, F.lit(at - datetime.timedelta(minutes=6))).isEmpty()


def test_sitemap_document(spark):
    topics = spark.createDataFrame([("/tag/a&b", 12), ("/tag/c", 9)], "path string, n long")
    doc = desk.sitemap_document(desk.sitemap(topics, "https://e.com", F.lit("2024-01-01"))).first()[0]
    assert doc.count("<url>") == 5 and "<loc>https://e.com/tag/a&amp;b</loc><lastmod>2024-01-01</lastmod>" in doc and "/tag/c" not in doc


def test_replies(spark):
    replies = ['{"a": 1}', 'x ```json\n{"b": {"c": 2}}\n``` y', "say {\"d\": 3} {bad}", "none", None, "```\n{broken\n```"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "r string").select(desk.json_text(F.col("r"))).collect()]
    assert got == ['{"a": 1}', '{"b": {"c": 2}}', '{"d": 3}', None, None, None]
    assert spark.range(1).select(text.trusted_description(F.lit("d"), F.lit(True))).first()[0] == ""

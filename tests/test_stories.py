import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyloom.functions.similarity import COMPATIBLE
from storyloom.operators import clustering, dedupe, evaluation
from storyloom.sources import feeds

ENTITIES = [(1, "Macklin Celebrini", "player"), (2, "Collin Graf", "player"), (3, "Will Smith", "player"), (9, "San Jose Sharks", "team")]
T0 = datetime(2026, 1, 10, 12)
UUID = "1b4e28ba-2fa1-41d2-883f-0016d3cca427"


def article(title, hours=0, entities=(), event="other", url=None, category="press", summary=None, key=None, text=None):
    return {"title": title, "published_at": T0 + timedelta(hours=hours), "entities": list(entities), "event_type": event, "url": url, "category": category, "llm_summary": summary, "story_key": key, "text": text or title}


def placed(spark, articles):
    schema = "title string, published_at timestamp, entities array<long>, event_type string, url string, category string, llm_summary string, story_key string, text string, id long, arrival long"
    rows = [a | {"id": k + 1, "arrival": k, "url": a["url"] or f"https://e.com/{k}"} for k, a in enumerate(articles)]
    names = spark.createDataFrame(ENTITIES, "id long, name string, entity_type string")
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    out = clustering.assign(clustering.features(frame, names)).collect()
    members = {r["id"]: (r["other"], r["route"]) for r in out if r["kind"] == "member"}
    return members, {r["id"]: r for r in out if r["kind"] == "story"}, {(r["id"], r["other"]): r["score"] for r in out if r["kind"] == "relation"}


SCENARIOS = {
    "identical title": ([article("Sharks name new captain for season"), article("Sharks name new captain for season", 1)], ["title"]),
    "publisher suffix": ([article("Sharks name new captain for season - Yahoo Sports"), article("Sharks name new captain for season | paNOW", 5)], ["title"]),
    "five day old copies": ([article("Old story told again by the wire", -120), article("Old story told again by the wire", -119)], ["title"]),
    "name bigram": ([article("Sharks Hire Jeff Kealty as new assistant general manager", 0, event="signing"), article("New assistant GM Jeff Kealty joins after years with Predators", 2, event="other")], ["title_name"]),
    "shared uuid": ([article("One headline", url=f"https://a.com/{UUID}/x"), article("Another entirely different wording", 90, url=f"https://b.com/y/{UUID}")], ["syndication"]),
    "same game": ([article("Sharks fall to Kings in overtime", event="game"), article("Celebrini scores twice as Kings win", 2, event="game")], ["game"]),
    "beyond the window": ([article("Story that lasted a while"), article("Story that lasted a while", 100)], ["new_cluster"]),
    "same star, other story": ([article("Macklin Celebrini Card Auction Nears Record", entities=[1, 9], event="prospect"), article("Pipeline Rankings put Celebrini at the very top", 1, [1, 9], "prospect")], ["new_cluster"]),
    "same star, same story": ([article("Celebrini signs extension worth millions", entities=[1, 9], event="signing"), article("Extension signed by Celebrini will last years", 1, [1, 9], "signing")], ["score"]),
    "keys agree": ([article("Alpha beta gamma", entities=[1], event="signing", key="celebrini-card-auction"), article("Delta epsilon zeta", 1, [1], "signing", key="celebrini-rookie-card-auction")], ["score"]),
    "keys differ": ([article("Celebrini signs extension worth millions", entities=[1], event="signing", key="celebrini-extension"), article("Extension signed by Celebrini will last years", 1, [1], "signing", key="pipeline-ranking-list")], ["new_cluster"]),
    "key on one side": ([article("Celebrini signs extension worth millions", entities=[1], event="signing", key="celebrini-extension"), article("Extension signed by Celebrini will last years", 1, [1], "signing")], ["score"]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    articles, routes = SCENARIOS[name]
    members, _, _ = placed(spark, articles)
    assert [members[k][1] for k in sorted(members)][1:] == routes
    assert (members[2][0] == 1) == (routes[0] != "new_cluster")


def test_joining_does_not_extend_a_story(spark):
    members, stories, _ = placed(spark, [article("Long running story of the summer"), article("Long running story of the summer", 60), article("Long running story of the summer", 120)])
    assert [members[k][0] for k in (1, 2, 3)] == [1, 1, 3] and stories[1]["first_seen_at"] == T0


def test_headline_prefers_the_better_source(spark):
    _, stories, _ = placed(spark, [article("Sharks name new captain for season - Blog Site", category="other"), article("Sharks name new captain for season", 1, category="official")])
    assert stories[1]["headline"] == "Sharks name new captain for season" and stories[1]["source_count"] == 2
    _, stories, _ = placed(spark, [article("Sharks name new captain for season - Blog Site"), article("Sharks name new captain for season", 0)])
    assert stories[1]["headline"] == "Sharks name new captain for season - Blog Site"


def test_near_miss_becomes_one_relation(spark):
    _, stories, relations = placed(spark, [article("Macklin Celebrini Card Auction Nears Record", entities=[1, 9], event="prospect"), article("Pipeline Rankings put Celebrini at the very top", 1, [1, 9], "prospect")])
    assert len(stories) == 2 and list(relations) == [(1, 2)] and 0.45 <= relations[1, 2] < 1


def told(id, title, hours, event):
    words = title.split()
    own = {"key": title, "key_words": words, "topic": words[:4], "head": words, "tokens": words, "names": words[:1], "s_key": ""}
    bare = dict.fromkeys(("people", "entities", "strip", "s_words", "s_topic", "s_names"), ())
    return bare | own | {"id": id, "arrival": id, "published": hours * clustering.HOUR, "event_type": event, "category": "press", "title": title, "uuid": None, "game": None, "summary": None, "story_key": None}


def test_title_index_against_every_title():
    """The index leaves out no title that a rule holds for, also after stories are forgotten."""
    random.seed(11)
    words = [a + b + "rk" for a in "bcdfgh" for b in "aeiou"]
    fold, seen, routes = clustering.Fold(), [], set()
    for k in range(700):
        title = " ".join(random.sample(words, random.randint(1, 9)))
        if seen and random.random() < 0.6:
            base = random.choice(seen[-60:]).split()
            how = random.randrange(3)
            title = " ".join([*base, random.choice(words)] if how == 0 else random.sample(base, len(base)) if how == 1 else [w[:-1] + "p" if random.random() < 0.2 else w for w in base])
        seen.append(title)
        v = told(k, title, k, random.choice(["signing", "trade", "other", "opinion"]))
        window = 48 if v["event_type"] == "opinion" else 72
        near = {i: s for i, s in fold.stories.items() if abs(s["first"] - v["published"]) <= window * clustering.HOUR}
        held = {}
        for i, s in near.items():
            for m in s["titles"].values():
                a, b = set(v["key_words"]), set(m["key_words"])
                jaccard, within, ratio = len(a & b) / len(a | b), len(a & b) / min(len(a), len(b)), SequenceMatcher(None, v["key"], m["key"]).ratio()
                named = a & b and v["names"][0] in m["names"] and len(a & b) >= 4 and jaccard >= 0.4 and (v["event_type"] == s["event"] or {v["event_type"], s["event"]} in map(set, COMPATIBLE))
                contained = len(a & b) >= 6 and within >= 0.9 and jaccard >= 0.55
                if ratio >= 0.85 or contained or named:
                    held.setdefault((max(ratio, within), jaccard, ratio), (i, "title" if ratio >= 0.85 else "containment" if contained else "title_name"))
        story, route, _ = fold.add(v)
        routes.add(route)
        assert (story, route) == held[max(held)] if held else route in ("score", "new_cluster")
        if k % 150 == 149:
            fold.expire(v["published"] - 100 * clustering.HOUR)
            assert set(fold.owner) == set(fold.titles) and set(fold.owner.values()) <= set(fold.stories)
    assert {"title", "containment", "title_name", "new_cluster"} <= routes


def test_labelled_pairs(spark):
    import pathlib

    pairs = feeds.labelled_pairs(spark, str(pathlib.Path(__file__).parent / "data" / "labelled_pairs.jsonl"))
    assert pairs.count() == 19
    names = pairs.select(F.explode("entities").alias("name")).distinct().withColumn("id", F.xxhash64("name")).withColumn("entity_type", F.when(F.col("name").contains("Sharks"), "team").otherwise("player"))
    found = evaluation.quality(evaluation.merged_pairs(pairs, names)).first()
    assert (found["tp"], found["fp"], found["fn"], found["tn"]) == (6, 1, 1, 11)
    assert abs(found["precision"] - 0.857143) < 1e-6 and abs(found["recall"] - 0.857143) < 1e-6


def test_greedy_dedupe(spark):
    rows = [
        (1, 1, "a", "u1", "t1"), (2, 1, "a", "u2", "t2"),  # 2 shares an item id with 1
        (3, 1, None, "u2", "t3"),  # shares a url with 2 alone, which is dropped: kept
        (4, 2, "a", "u4", "t1"),  # other source: item id and title are its own
        (5, 1, None, "u5", "t1"), (6, 2, "", "u4", ""), (7, 3, "", "u7", ""), (8, 3, "", "u8", ""),
    ]
    items = spark.createDataFrame(rows, "id long, source_id long, source_item_id string, canonical_url string, raw_title string")
    assert sorted(r["id"] for r in dedupe.greedy(items).collect()) == [1, 3, 4, 7, 8]
    history = spark.createDataFrame([(0, 9, "z", "u8", "t9")], items.schema)
    assert sorted(r["id"] for r in dedupe.greedy(items, history).collect()) == [1, 3, 4, 7]
    assert dedupe.greedy(items.limit(0)).count() == 0


def brute_greedy(rows):
    seen, kept = set(), []
    for id, source, item, url, title in sorted(rows):
        keys = {("u", url)} | ({("i", source, item)} if item else set()) | ({("t", source, title)} if title else set())
        if not keys & seen:
            kept.append(id)
            seen |= keys
    return kept


def test_greedy_dedupe_against_brute_force(spark):
    random.seed(5)
    rows = [(k, random.randint(1, 3), random.choice([None, "a", "b", "c", "d", "e"]), f"u{random.randint(1, 60)}", random.choice(["", *(f"t{x}" for x in range(25))])) for k in range(120)]
    items = spark.createDataFrame(rows, "id long, source_id long, source_item_id string, canonical_url string, raw_title string")
    assert sorted(r["id"] for r in dedupe.greedy(items).collect()) == brute_greedy(rows)


def test_age_gate(spark):
    now = T0
    rows = [(1, 1, "https://e.com/a?utm_source=1", "x", T0, False), (2, 1, "https://e.com/b", "y", T0 - timedelta(days=8), False), (3, 1, "https://e.com/c", "z", T0 - timedelta(days=30), True), (4, 1, "", "w", T0, False), (5, 1, "https://e.com/d", "v", None, False)]
    items = spark.createDataFrame(rows, "id long, source_id long, original_url string, raw_title string, published_at timestamp, stub boolean")
    kept = dedupe.arrivals(items, now)
    assert {r["id"]: r["canonical_url"] for r in kept.collect()} == {1: "https://e.com/a", 3: "https://e.com/c", 5: "https://e.com/d"}
    paged = kept.withColumn("page_date", F.when(F.col("id") == 1, F.lit(T0 - timedelta(days=400))))
    assert [r["id"] for r in dedupe.dated(paged, now).collect()] == [3]


def by_kind(rows):
    out = {kind: sorted(r for k, *r in rows if k == kind) for kind in ("member", "story", "relation")}
    assert sum(map(len, out.values())) == len(rows) and all(out.values())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_spans_equal_one_fold(spark, monkeypatch, hot):
    """Folded by spans and mended at their borders, articles give the stories of one fold over all, whatever their order of arrival."""
    for name, n in (("BUCKET", 10), ("SPAN", 60), ("WARM", 20)):
        monkeypatch.setattr(clustering, name, n)
    rounds, mend = [], clustering._mend
    monkeypatch.setattr(clustering, "_mend", lambda *a: rounds.append(a[-2:]) or mend(*a))
    rng = random.Random(3)
    words = [a + b + c + "rk" for a in "bcdfgh" for b in "aeiou" for c in "lmn"]
    people, rows = [[], [1, 9], [2], [3, 9]], []
    for k in range(400):
        title = " ".join(rng.sample(words, 6))
        if hot and k % 5 == 0:
            title = "One and the same line told by every outlet"
        elif rows and rng.random() < 0.4:
            title = rng.choice(rows[-25:])["title"]
        late = rng.randint(-20, 20) if k % 7 == 0 else 0
        rows.append(article(title, 4 * k + late, rng.choice(people), rng.choice(["signing", "trade", "other", "game"]), category=rng.choice(["press", "other"]), summary=title if k % 4 == 0 else None, url=f"https://a.com/{UUID[:-3]}{k // 60:03d}/x" if k % 30 == 5 else None))
    schema = "title string, published_at timestamp, entities array<long>, event_type string, url string, category string, llm_summary string, story_key string, text string, id long, arrival long"
    full = [a | {"id": 2**60 + k, "arrival": k // 2, "url": a["url"] or f"https://e.com/{k}"} for k, a in enumerate(rows)]
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in full], schema)
    featured = clustering.features(frame, spark.createDataFrame(ENTITIES, "id long, name string, entity_type string"))
    out = clustering.assign(featured).collect()
    got = by_kind([(r["kind"], r["id"], r["other"], r["route"], r["score"], r["headline"], r["event_type"], r["first_seen_at"], r["last_seen_at"], r["source_count"]) for r in out])

    fold = clustering.Fold()
    members = [(v["id"], *fold.add(v)) for v in clustering.records(featured.toPandas())]
    at = lambda micros: datetime.fromtimestamp(micros / 1e6)
    want = [("member", v, s, route, score, *[None] * 5) for v, s, route, score in members]
    want += [("story", s["id"], None, None, None, s["head"]["title"], s["event"], at(s["first"]), at(s["last"]), s["count"]) for s in fold.stories.values()]
    want += [("relation", a, b, None, score, *[None] * 5) for (a, b), score in fold.relations.items()]
    assert got == by_kind(want)
    assert rounds and (not hot or [alone for _, alone in rounds] == [True, False])


def test_fold_lets_go_of_stories_out_of_reach():
    """What stays in memory does not grow with the feed."""
    fold, told_of = clustering.Fold(), []
    for k in range(600):
        fold.add(told(k, f"word{k} and{k} other{k}", k, "other"))
        told_of += fold.settle((k + 1) * clustering.HOUR)[0]
        assert len(fold.stories) <= 97 >= len(fold.titles) and len(fold.by_day) <= 10
    assert sum(s["count"] for s in told_of + fold.settle(None)[0]) == 600 and len(told_of) > 5 and not fold.stories

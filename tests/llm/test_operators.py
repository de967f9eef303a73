"""Operators over small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import fmindex, langid, lattice, minhash, packing, quality, queries, sharding, templates, tokenfile, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    """200 documents, and rows that are null, empty, wordless, repeated, very long; columns named like the operators' own."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "One"), (1005, "word " * 40_000), (1006, "!!! ???"), (1007, None), (3, "same id, other text here"), (None, "no id at all")]
    more = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in odd], base.schema)
    repeat = base.filter("doc_id < 3")
    return base.union(more).union(repeat).withColumn("size", F.lit(1)).withColumn("key", F.lit("k")).withColumn("band", F.lit(2)).withColumn("rank", F.lit(3)).withColumn("shard", F.lit(4)).cache()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    where = {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect() if r["doc_id"] is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_shards_against_brute_force(spark, monkeypatch, hot):
    """Groups of copies packed whole: no shard holds more than best fit decreasing of the exact sizes needs."""
    monkeypatch.setattr(sharding, "HOT", hot)
    rng = random.Random(4)
    texts = ["x" * rng.randrange(0, 900) + str(k) for k in range(400)]
    made = [(k, rng.choice(texts[:40]) if k % 3 else rng.choice(texts)) for k in range(3000)] + [(None, None), (7, texts[0])]
    got = sharding.shard(spark.createDataFrame(made, "doc_id long, text string").withColumn("rows", F.lit(1))).collect()
    assert len(got) == len(made)
    total, where, size = {}, {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
        size[r["text_crc32"]] = size.get(r["text_crc32"], 0) + r["size"]
    assert all(len(s) == 1 for s in where.values()) and len(total) == 24
    capacity = max(max(size.values()), -(-sum(size.values()) // 24))
    while True:
        room = [capacity] * 24
        for s in sorted(size.values(), reverse=True):
            fits = [x for x in room if x >= s]
            if not fits:
                break
            room[room.index(min(fits))] -= s
        else:
            break
        capacity += 1
    assert max(total.values()) <= 1.01 * capacity


def brute_duplicates(pairs, n, percent):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            common = len(s & t)
            if common and 100 * common >= percent * (len(s) + len(t) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, n, percent):
    own = docs.filter("doc_id IS NOT NULL")
    got = minhash.near_duplicates(own, n, percent).collect()
    want = brute_duplicates([(r["doc_id"], r["text"]) for r in own.collect()], n, percent)
    assert len(got) == own.count() and all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert {r["doc_id"] for r in got if r["n_shingles"] == 0} == {1000, 1001, 1002, 1007}


def test_near_duplicates_of_nothing_and_null_ids(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert rows(minhash.near_duplicates(two), "doc_id", "component_id", "kept") == [(5, 5, True), (None, 5, False), (None, None, True)]


def test_large_bucket_in_blocks(spark, monkeypatch):
    """A group of near copies that link in part goes through blocks, and keeps every link."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 32)
    monkeypatch.setattr(minhash, "PAIRED", 4)
    random.seed(2)
    base = [f"w{k}" for k in range(80)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(80)] = f"x{random.randrange(9)}"
        made.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_duplicates(made, 3, 85)


def brute_links(pairs):
    fine = {i: np.array(v, float) for i, v in pairs if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(fine)
    unit = np.array([fine[i] / np.linalg.norm(fine[i]) for i in ids])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in zip(*np.nonzero(near)):
        p, q = find(ids[i]), find(ids[j])
        root[max(p, q)] = min(p, q)
    return dict(zip(ids, near.sum(axis=1).tolist())), {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [2, 16, 1000])
def test_near_vectors(spark, monkeypatch, small):
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 16)
    monkeypatch.setattr(lattice, "SMALL", small)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((6, 64))
    made = [(k, (centre[k % 6] + rng.standard_normal(64) * (0.05 if k % 3 else 0.2)).astype(np.float32).tolist()) for k in range(150)]
    made += [(1000, None), (1001, [0.0] * 64), (1002, [None] * 64), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1005, [1.0, 2.0])]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("cell", F.lit(2))
    got = {r["vec_id"]: r for r in lattice.near_vectors(frame).collect()}
    want, component = brute_links(made)
    assert {i: r["n_links"] for i, r in got.items()} == {i: want.get(i, 0) for i, _ in made}
    assert {i: (r["component_id"], r["kept"]) for i, r in got.items()} == {i: (component.get(i, i), component.get(i, i) == i) for i, _ in made}
    assert max(want.values()) > 10 and len(set(component.values())) >= 6
    twice = lattice.near_vectors(frame.filter("vec_id = 0").union(frame.filter("vec_id = 0"))).collect()
    assert [r["n_links"] for r in twice] == [1, 1]
    assert lattice.near_vectors(frame.limit(0)).count() == lattice.near_vectors(frame.filter("vec_id = 1000")).count() - 1 == 0


def test_a_chain_of_vectors(spark, monkeypatch):
    """Neighbours of a long chain link, its ends do not; some links have copies at an end."""
    monkeypatch.setattr(lattice, "SMALL", 16)
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    made = [(k, (np.cos(k * 0.2) * a + np.sin(k * 0.2) * b).astype(np.float32).tolist()) for k in range(30)]
    made += [(100 + k, made[k][1]) for k in (0, 7, 7)] + [(200, made[29][1])]
    got = {}
    for r in lattice.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"]))
    unit = {k: np.array(v, float) / np.linalg.norm(v) for k, v in made}
    links = [sum(unit[i] @ np.array(w, float) / np.linalg.norm(w) >= 0.95 for _, w in made) - 1 for i, _ in made]
    assert got == {i: {(n, 0)} for (i, _), n in zip(made, links)} and max(links) <= 8
    odd = [(None, made[0][1]), (3, made[0][1]), (3, made[20][1]), (None, made[20][1]), (4, made[10][1])]
    got = lattice.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == [(3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True), (None, 1, 3, False), (None, 1, 3, False)]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    made = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([64] * 5 + [32] * 3)]
    made += [(10 + k, v) for k, v in made] + [(20, None), (21, [0.0] * 32)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<float>")).collect()}
    want = {k: (1, k, True) for k in range(8)} | {10 + k: (1, k, False) for k in range(8)} | {k: (0, k, True) for k in (20, 21)}
    assert got == want


def test_site_templates(spark):
    page = '<body><div>Follow us on {host}</div><div class="ad">x</div><article><h1>T{k}</h1><p>Text of page {k}</p><p>A passage that all share</p></article><div>Unique {k}</div></body>'
    made = [(k, f"https://{h}.com/{k}", page.format(host=h, k=k).replace("article", "section")) for h in "ab" for k in range(8)]
    made += [(100, None, None), (101, "::bad", ""), (102, "https://c.com", "plain &amp; text"), (0, "https://a.com/0", made[0][2])]
    frame = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {(r["page_id"], r["url"]): r["text"] for r in templates.main_text(frame).collect()}
    assert got[3, "https://a.com/3"] == "T3\nText of page 3\nA passage that all share"
    assert got[100, None] == "" and got[101, "::bad"] == "" and got[102, "https://c.com"] == "plain & text"
    assert templates.main_text(frame).count() == len(made) and templates.main_text(frame.limit(0)).count() == 0


def _site(k, words):
    """A page without any telling name, whose menu, notice and foot have other words on every page."""
    menu = "".join(f"<li><a href='/{k}-{x}'>link {k} {x}</a></li>" for x in range(3 + k % 4))
    return f"<body><div><ul>{menu}</ul></div><div>Notice number {k} of today</div><div class='widget'><h1>Title {k}</h1><p>{words}</p><ul><li>point {k}</li></ul><p>The passage that all share.</p></div><div><p>Foot {k}</p></div></body>"


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_templates_decide_without_names(spark, monkeypatch, limit):
    """Counted shapes delete what no name tells, and spare a core that a name would delete; without the counts both go wrong."""
    monkeypatch.setattr(templates, "BROADCAST_BYTES", limit)
    body = lambda k: " ".join(f"word{k}x{x}" for x in range(30 + k))
    made = [(k, "https://a.com/", _site(k, body(k))) for k in range(12)] + [(50 + k, "https://b.com/", _site(k, body(k))) for k in range(4)]
    made += [(3, "https://a.com/", made[3][2])] * 300 + [(99, "https://a.com/", made[2][2].replace("<body>", "<body><div class='rare'>Seen once</div>"))]
    frame = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("shapes", F.lit(1)).withColumn("cores", F.lit(2))
    text = lambda k: f"Title {k}\n{body(k)}\npoint {k}\nThe passage that all share."
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert all(got[k] == text(k) for k in range(12)) and got[99] == f"Seen once\n{text(2)}"
    assert "Foot 1" in got[51] and "Title 1" not in got[51]  # four pages are too few to count
    monkeypatch.setattr(templates, "MIN_PAGES", 1000)
    without = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert all("Foot" in without[k] and "Title" not in without[k] for k in range(12))


def test_templates_against_a_plain_count(spark):
    """The counted hashes of a random site equal those of dictionaries filled page by page."""
    rng = random.Random(11)
    piece = lambda: rng.choice(["<div>Menu <a>x</a></div>", "<div><ul><li>a</li><li>b</li></ul></div>", f"<section><p>w{rng.randrange(50)}</p></section>", "<div class='c1'>same</div>", f"<div class='c{rng.randrange(3)}'>t{rng.randrange(4)}</div>"])
    made = [(k, f"https://{rng.choice('ab')}.com/", "<body>" + "".join(piece() for _ in range(6)) + f"<article><h1>T{k % 40}</h1><p>{'word ' * rng.randrange(40)}</p></article></body>") for k in range(120)]
    made += made[:30]
    frame = spark.createDataFrame(made, "page_id long, url string, html string")
    want = {}
    for _, url, html in made:
        page = templates.Page(html)
        for kind, found in ((templates.EXACT, [(h, 1, 1, h) for h in page.candidates()]), (templates.SHAPE, [(h, 1, 1, h) for h in page.shapes()]), (templates.PLACE, page.places())):
            for h, share, heading, exact in found:
                want.setdefault((url[8], kind, h), {})[page.body()] = (share, heading, exact)
    keep = lambda kind, own: len(own) >= 5 and (kind != templates.PLACE or all(sum(x[c] for x in own.values()) / len(own) >= 0.5 for c in (0, 1)) and 2 * len({x[2] for x in own.values()}) >= len(own))
    expected = {(host, kind): set() for host in "ab" for kind in (templates.SHAPE, templates.PLACE)}
    for (host, kind, h), own in want.items():
        if keep(kind, own) and kind != templates.EXACT:
            expected[host, kind].add(h)
    sites, lists = templates.templates(frame)
    got = {}
    for r in sites.collect():
        got[r["host"][0], templates.SHAPE], got[r["host"][0], templates.PLACE] = set(r["shapes"]), set(r["cores"])
    assert got == expected and all(expected.values())
    exact = {(host, h) for (host, kind, h), own in want.items() if kind == templates.EXACT and keep(kind, own)}
    listed = {(r["host"][0], h) for r in lists.collect() for h in r["templates"]}
    assert listed <= exact


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_templates_of_a_large_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(templates, "BROADCAST_PAGES", broadcast)
    made = [(k, "https://a.com/", f"<body><div>Block {k // 6}</div><article><p>Text {k}</p></article><div>Notice {k // 4}</div><section>Part {k // 5}</section></body>".replace("article", "section")) for k in range(300)]
    frame = spark.createDataFrame([*made, (300, "https://a.com/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert got == {300: ""} | {k: f"Text {k}\nNotice {k // 4}" for k in range(300)}


def test_templates_beside_a_group_of_copies(spark):
    page = "<body><div>Menu of all</div><section>Text {k}</section></body>"
    made = [(k, "https://a.com/", page.format(k=k)) for k in range(20)] + [(k, "https://a.com/", page.format(k="copied")) for k in range(20, 1020)]
    frame = spark.createDataFrame([*made, *((k, "https://a.com/", None) for k in range(2000, 2100))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert [got[k] for k in range(20)] == [f"Text {k}" for k in range(20)] and {got[k] for k in range(20, 1020)} == {"Text copied"}


def test_packing(docs):
    from tokenizers import Tokenizer

    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=256).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4"))
    assert sum(r["length"] for r in got) == sum(len(x) for own in want.values() for x in own)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in want[r["doc_id"]])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert all(o == sum(n for _, n in pieces[:k]) for k, (o, _) in enumerate(pieces)) and sum(n for _, n in pieces) <= 256
    assert sorted(by) == list(range(len(by))) and len(by) <= 1.02 * sum(r["length"] for r in got) / 256 + 2
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [known[r["doc_id"]] == r["predicted"] for r in got if r["held_out"] and r["doc_id"] in known]
    assert np.mean(right) >= 0.85
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = rows(quality.accepted(docs, labels), *docs.columns)
    assert {k[0] for k in kept} <= {r["doc_id"] for r in got if r["predicted"]} and len(kept) == sum(r["predicted"] for r in got)
    assert quality.scores(docs.limit(0), labels).count() == 0


def brute_contamination(documents, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[k : k + n]), set()).update([i] if i is not None else [])
    out = []
    for i, t in documents:
        w = word.findall((t or "").translate(LOWER))
        hit, own = set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    own |= phrases[p]
        names = sorted(map(str, own))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 3, 40])
def test_decontamination_in_small_blocks(spark, monkeypatch, block):
    """Spans, items and texts do not depend on how many blocks the benchmark takes."""
    items = [(1, "a b c"), (2, "c d e"), (2, "x y z w"), (None, "q r s"), (3, "a b c"), (4, "A one-word"), (5, None), (6, "h i j k l m n"), (1, "y z w v")]
    made = [(1, "p a b c d e q"), (2, "x y z w v"), (3, "q r s"), (4, None), (5, ""), (6, "-- !"), (None, "h i j k l m n o"), (6, "a one, word; c, D! e"), (1, "p a b c d e q"), (7, "k m l " * 30_000)]
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("spans", F.lit(1)).withColumn("c0", F.lit("c")).withColumn("a.b", F.lit("d"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit(1)).withColumn("w", F.lit(2))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_contamination(made, items, 3)
    whole = fmindex.decontaminated(frame, bench, 3)
    assert whole.columns == frame.columns
    texts = rows(whole, *(c for c in frame.columns if c != "a.b"))
    assert rows(fmindex.digest(fmindex.contamination(frame, bench, 3)), *names) == want
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", block)
    assert next(fmindex._blocks(bench, 3, "item_id", "text"))[1] > (1 if block < 40 else 0)
    assert rows(fmindex.digest(fmindex.contamination(frame, bench, 3)), *names) == want
    assert rows(fmindex.decontaminated(frame, bench, 3), *(c for c in frame.columns if c != "a.b")) == texts
    assert {(t[0], t[1]) for t in texts} >= {(1, "p  q"), (4, None), (5, ""), (6, "-- !"), (None, " o"), (7, "k m l " * 30_000)} and not {2, 3} & {t[0] for t in texts}


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_contamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", block)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [(100, None), (101, ""), (102, "one"), (103, "other text"), (104, "other text"), (105, "-- !")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = rows(fmindex.digest(fmindex.contamination(docs, benchmark)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items) and any(r[5] for r in got)
    assert fmindex.contamination(docs.limit(0), benchmark).count() == 0
    assert not any(r["items"] for r in fmindex.contamination(docs, benchmark.limit(0)).collect())


def test_decontaminated_text(spark):
    frame = spark.createDataFrame([(1, "Keep this. A b c d! And this", "x"), (2, "a b c d", "y"), (3, None, "z"), (4, "!!", "w"), (5, "a b c", "v")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "a B c D")], "item_id long, text string")
    assert rows(fmindex.decontaminated(frame, bench), "doc_id", "text", "lang") == [(1, "Keep this. ! And this", "x"), (3, None, "z"), (4, "!!", "w"), (5, "a b c", "v")]


def test_decontaminated_text_of_several_blocks(spark, docs, monkeypatch):
    passage = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(passage[k : k + 15])) for k in range(0, 26, 5)] + [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(2000, f"keep {' '.join(passage)} this"), (2001, " ".join(passage))], "doc_id long, text string")
    frame = docs.select("doc_id", "text").union(more)
    want = rows(fmindex.decontaminated(frame, bench), "doc_id", "text")
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 300)
    assert next(fmindex._blocks(bench, 10, "item_id", "text"))[1] > 2
    assert rows(fmindex.decontaminated(frame, bench), "doc_id", "text") == want
    assert (2000, "keep  this") in want and not any(i == 2001 for i, _ in want)


def test_token_files(docs):
    from tokenizers import Tokenizer

    own = docs.filter("doc_id <> 3 AND doc_id > 2")
    got = tokenfile.token_files(own, public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    by = {r["doc_id"]: r for r in got}
    for r in sorted(own.collect(), key=lambda r: r["doc_id"]):
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        f = by[r["doc_id"]]
        assert (f["start"], f["n_tokens"], f["ids_crc32"], bytes(f["ids"])) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert tokenfile.token_files(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    again = tokenfile.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    ends = sorted((r["start"], r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else -1) for r in again)
    assert [a for a, _, _ in ends] == [sum(n for _, n, _ in ends[:k]) for k in range(len(ends))] and [i for _, _, i in ends] == sorted(i for _, _, i in ends)
    assert tokenfile.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == docs.count()


def test_ids_of_a_stretch_by_the_index(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 1 << 14)
    out, own = f"file://{tmp_path}/tokens", docs.filter("doc_id > 2")
    tokenfile.write_tokens(own, public_tokenizers.path("byte_bpe_50k.json"), out)
    whole = b"".join(bytes(r["ids"]) for r in sorted(tokenfile.read_tokens(spark, out).collect(), key=lambda r: r["start"]))
    total = len(whole) // 4
    for start, length in ((0, 1), (511, 2), (5_000, 40_000), (total - 3, 10), (total, 5)):
        got = sorted(map(tuple, tokenfile.read_range(spark, out, start, length).collect()))
        assert b"".join(bytes(x) for _, x in got) == whole[4 * start : 4 * (start + length)] and (not got or got[0][0] == start)


def brute_languages(made, sample):
    """Nearest centroid written out with dictionaries of byte n-grams, for texts that all enter the sample."""
    import math

    def grams(t):
        low = "".join(c if c.isalpha() else " " for c in t.lower())
        low = re.sub(" +", " ", low).encode()
        out = {}
        for n in range(1, 5):
            for k in range(len(low) - n + 1):
                out[low[k : k + n]] = out.get(low[k : k + n], 0) + 1
        return out

    train = {t: lang for i, t, lang in made if zlib.crc32(str(i).encode()) % 4 != 2}
    rows_, df = [(i, t, lang) for i, t, lang in made if zlib.crc32(str(i).encode()) % 4 != 2], {}
    for _, t, _ in rows_:
        for g in grams(t):
            df[g] = df.get(g, 0) + 1

    def unit(t):
        v = {g: math.log1p(c) * (math.log((1 + len(rows_)) / (1 + df.get(g, 0))) + 1) for g, c in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    centre = {}
    for t, lang in train.items():
        for g, x in unit(t).items():
            centre.setdefault(lang, {}).setdefault(g, 0.0)
            centre[lang][g] += x
    norm = {lang: math.sqrt(sum(x * x for x in c.values())) for lang, c in centre.items()}
    return {i: max(sorted(centre), key=lambda lang: sum(x * centre[lang].get(g, 0.0) for g, x in unit(t).items()) / norm[lang]) for i, t, _ in made}


def test_languages_against_brute_force(spark, monkeypatch):
    """One centroid a language and no shared places of the hash to speak of: the same language for every text."""
    monkeypatch.setattr(langid, "CENTROIDS", 1)
    base = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) BETWEEN 200 AND 3000").select("doc_id", "text", "lang").collect()
    made = [tuple(r) for r in base]
    want = brute_languages(made, langid.SAMPLE)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99 and len(got) > 80


def test_copies_are_drawn_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    base = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 200").select("doc_id", "text", "lang").collect()]
    copied = [(10_000 + k, base[0][1], base[0][2]) for k in range(2000)]
    frame = spark.createDataFrame(base + copied, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert set(model.names) == {x for _, _, x in base} and all((model.owner == k).sum() <= langid.CENTROIDS for k in range(len(model.names)))
    got = langid.languages(frame).filter("doc_id < 10000").collect()
    truth = {i: x for i, _, x in base}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) >= 0.95


def test_languages(docs):
    got = langid.languages(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (1000, 1001, 1002, 1006, 1007):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    right = [truth[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean(right) >= 0.95
    assert {r["lang_pred"] for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages(docs.limit(0)).count() == 0


FOREIGN = {
    "it": "Il governo ha annunciato ieri nuove misure per sostenere le famiglie. Secondo gli esperti, il provvedimento potrebbe avere effetti positivi sulla crescita economica del paese.",
    "nl": "De regering heeft gisteren nieuwe maatregelen aangekondigd om gezinnen te steunen. Volgens deskundigen kan het besluit de komende jaren een gunstig effect hebben op de groei.",
    "pl": "Rząd ogłosił wczoraj nowe środki wsparcia dla rodzin. Zdaniem ekspertów decyzja ta może mieć pozytywny wpływ na wzrost gospodarczy kraju w najbliższych latach.",
    "fi": "Hallitus ilmoitti eilen uusista toimista perheiden tukemiseksi. Asiantuntijoiden mukaan päätöksellä voi olla myönteisiä vaikutuksia maan talouskasvuun tulevina vuosina.",
    "ru": "Правительство вчера объявило о новых мерах поддержки семей. По мнению экспертов, решение может положительно повлиять на экономический рост страны.",
    "zh": "政府昨天宣布了支持家庭的新措施。专家认为，这一决定在未来几年可能对国家的经济增长产生积极影响。",
    "hex": hashlib.sha512(b"a").hexdigest() * 5,
    "made up": "xkq zvw qqj wvx kkz jqx vvq zzk xwj qkv zxq wkj vqz jjx kwq zvx qwk xjz kvq wzj xqv kzw jvx qzk wxv jkq",
    "base64": base64.b64encode(random.Random(1).randbytes(600)).decode(),
}


def test_languages_not_learned_are_rejected(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000_000 + k, t, None) for k, t in enumerate(FOREIGN.values())], "doc_id long, text string, lang string")
    got = langid.languages(base.union(odd)).collect()
    assert all(r["rejected"] for r in got if r["doc_id"] >= 10_000_000)
    clean = [r["rejected"] for r in got if r["held_out"] and r["doc_id"] < 10_000_000]
    assert np.mean(clean) <= 0.02


def test_url_filter(spark):
    listed = [("block", "add", "domain", "bad.com", "2024-01-10"), ("block", "remove", "domain", "bad.com", "2024-02-01"), ("block", "add", "domain", "Bad.com", "2024-03-01"), ("allow", "add", "host", "www.bad.com", "2024-03-10"), ("block", "add", "host", "one.org", "2024-01-01"), ("block", "add", "domain", None, "2024-01-01"), ("block", "add", "host", "one.org", "2024-01-01")]
    lists = spark.createDataFrame(listed, "list string, action string, kind string, key string, at string").withColumn("at", F.to_timestamp("at"))
    cases = [
        ("http://bad.com/x", "2024-01-09", False), ("http://bad.com/x", "2024-01-10", True), ("http://a.b.bad.com:80", "2024-01-31", True), ("http://bad.com", "2024-02-01", False), ("http://u:p@BAD.com./", "2024-03-05", True),
        ("https://www.bad.com/y", "2024-03-09", True), ("https://www.bad.com/y", "2024-03-10", False), ("https://x.www.bad.com", "2024-03-10", True), ("http://notbad.com", "2024-03-10", False), ("http://sub.one.org", "2024-03-10", False),
        ("http://one.org?q", "2024-03-10", True), (None, "2024-03-10", False), ("no url", "2024-03-10", False), ("http://bad.com/x", None, False), ("http://bad.com/x", "2024-01-10", True),
    ]
    frame = spark.createDataFrame([(k, u, t) for k, (u, t, _) in enumerate(cases)], "n int, url string, t string").withColumn("captured_at", F.to_timestamp("t"))
    for c in ("key", "rule", "_host", "host", "matched", "blocked", "_time", "list", "start", "_capture", "a.b"):
        frame = frame.withColumn(c, F.lit("clash"))
    out = urlfilter.decide(frame, lists)
    assert sorted(out.columns) == sorted(frame.columns)
    got = {r["n"]: (r["blocked"], r["key"]) for r in out.collect()}
    assert got == {k: (b, "clash") for k, (_, _, b) in enumerate(cases)}
    assert not any(r["blocked"] for r in urlfilter.decide(frame, lists.limit(0)).collect()) and urlfilter.decide(frame.limit(0), lists).count() == 0


@pytest.mark.parametrize(
    ("url", "host"),
    [("http://[::1]:80/x", "[::1]"), ("//Host.com/x", "host.com"), ("  https://a.com", "a.com"), ("http://a@b@host.com:8/x", "host.com"), ("http://a.com./@b.com", "a.com"), ("http:///x", None), ("mailto:x@y.z", None), ("a.com/x", None), (None, None), ("http://a.com?u=//b.com", "a.com")],
)
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(urlfilter.host_of(F.col("u"))).first()[0] == host


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_url_filter_against_brute_force(spark, monkeypatch, limit):
    """Long histories over many buckets, by broadcast and by shuffle, in a session outside UTC."""
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(urlfilter, "BUCKET_DAYS", 3)
    rng, day = random.Random(5), 86400
    keys = ["com", "x.com", "a.x.com", "b.a.x.com", "y.org", "1.2.3.4", "3.4"]
    made = [(rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), rng.choice(["host", "domain"]), rng.choice(keys), 1_700_000_000 + rng.randrange(200) * day) for _ in range(120)]
    hosts = ["x.com", "a.x.com", "b.a.x.com", "c.b.a.x.com", "y.org", "z.y.org", "1.2.3.4", "com"]
    asked = [(k, f"http://{rng.choice(hosts)}/p", 1_700_000_000 + rng.randrange(210) * day) for k in range(300)]

    def want(url, t):
        host = url[7:-2]
        best = (0, False, None)
        for kind in ("host", "domain"):
            for name in ("block", "allow"):
                for key in keys:
                    if not (host == key or kind == "domain" and host.endswith("." + key) and host != "1.2.3.4"):
                        continue
                    events = sorted((at, action) for ls, action, kd, ky, at in made if (ls, kd, ky) == (name, kind, key) and at <= t)
                    if events and events[-1][1] == "add":  # of one moment the last by name
                        best = max(best, (len(key), name == "allow", name))
        return best[2] == "block"

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        lists = spark.createDataFrame(made, "list string, action string, kind string, key string, at long").withColumn("at", F.timestamp_seconds("at"))
        frame = spark.createDataFrame(asked, "n int, url string, t long").withColumn("captured_at", F.timestamp_seconds("t"))
        got = {r["n"]: r["blocked"] for r in urlfilter.decide(frame, lists).collect()}
        assert got == {k: want(u, t) for k, u, t in asked} and 0 < sum(got.values()) < len(got)
        first = urlfilter.filtered(spark.createDataFrame([(1, "http://spam-farm.example.org/")], "page_id long, url string")).first()
        assert (first["captured_on"], first["blocked"]) == ("2024-01-02", True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dated_list_from_files(spark, tmp_path):
    (tmp_path / "list.csv").write_text("list,action,kind,key,at\nblock,add,domain, Bad.com ,2024-01-10\nblock,remove,domain,bad.com,2024-02-01T12:30:00\nblock,add,nothing,x.com,2024-01-01\nblock,add,host,y.com,soon\n")
    got = urlfilter.read_entries(spark, str(tmp_path / "list.csv")).select("key", "action", F.unix_seconds("at").alias("at")).collect()
    assert sorted(map(tuple, got)) == [("bad.com", "add", 1704844800), ("bad.com", "remove", 1706790600)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df, *names) == sorted((tuple(r) for r in found.fetchall()), key=repr)

"""Each stage against a plain version, over rows that are null, empty, very long, tied, repeated, with columns of clashing names."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
langid, packing, quality = (pytest.importorskip(f"storyloom.llm.{n}") for n in ("langid", "packing", "quality"))
from test_operators import LOWER, brute_contamination, brute_duplicates  # noqa: E402

DATA = "/root/testdata/sf0.001"
STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    good = base.filter("length(text) BETWEEN 300 AND 900").orderBy("doc_id").first()["text"]
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = " ".join(r["text"] for r in base.filter("length(text) > 500").orderBy("doc_id").limit(40).collect())
    odd = [(5, good), (5, good), (5, good + " and more of it"), (None, good), (None, "Quite another text that stands alone."), (None, None), (7001, None), (7002, ""), (7003, " \n\t"), (7004, "!!! ??? 123"), (7005, f"{good} {passage} {good}"), (7006, passage), (7007, (long + " ") * (1 + 200_000 // len(long.split()))), (None, good)]
    more = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in odd], base.schema)
    out = base.union(more)
    for c in ("f", "label", "lang_pred", "_row", "_line", "key", "spans", "c0", "hash", "rank", "a.b"):
        out = out.withColumn(c, F.lit("clash"))
    return spark.createDataFrame(out.collect(), out.schema)


def texts(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_quality_by_row(spark, docs):
    out = STAGE["quality"](spark, docs, DATA)
    assert out.columns == docs.columns
    # The score of a text is one and the same wherever it stands.
    frame = docs.collect()
    own = spark.createDataFrame([(k, r["doc_id"], r["text"]) for k, r in enumerate(frame)], "line long, doc_id long, text string")
    model = quality.fit(
        own.select("doc_id", "text").mapInArrow(quality._features(1), "doc_id long, f array<double>"), spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality"), quality.held()
    )
    raw = [(r["text"] or "").encode() for r in frame]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    want = model.score(quality.statistics(data, offsets)) >= 0.3
    assert texts(out.collect()) == texts(r for r, w in zip(frame, want) if w)
    assert 0 < out.count() < len(frame)


def test_language_by_row(spark, docs):
    out = STAGE["language"](spark, docs, DATA).collect()
    model = langid.fit(docs.select("doc_id", "text", "lang"))

    def near(t):
        if t is None or not any(map(str.isalpha, t)):
            return False
        raw = t.encode()
        x = langid.counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        v = np.log1p(x[0]) * model.idf
        best = (v / np.linalg.norm(v)) @ model.centre
        k = int(best.argmax())
        return best[k] >= model.limit[model.owner[k]] * np.sqrt((x > 0).sum() / ((x > 0).sum() + langid.HALF))

    assert texts(out) == texts(r for r in docs.collect() if near(r["text"]))
    assert not {7001, 7002, 7003, 7004} & {r["doc_id"] for r in out}


def test_near_duplicates_by_row(spark, docs):
    out = STAGE["near_dedup"](spark, docs, DATA)
    assert out.columns == docs.columns
    rows = docs.collect()
    component = brute_duplicates([(k, r["text"]) for k, r in enumerate(rows)], 5, 80)
    want = {}
    for k, r in enumerate(rows):
        mine = (r["doc_id"] is None, r["doc_id"] or 0)
        want[component[k]] = min(want.get(component[k], (mine, r["text"])), (mine, r["text"]), key=lambda x: x[0])
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(None if m[0] else m[1] for m, _ in want.values())
    alone = {t for m, t in want.values()}
    assert sum(r["text"] in alone for r in got) >= len(got) - 2 and sum(r["doc_id"] == 5 for r in got) <= 2


def test_decontamination_by_row(spark, docs):
    out = STAGE["decontamination"](spark, docs, DATA)
    assert out.columns == docs.columns
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = docs.collect()
    found = {k: (n, hit) for k, n, hit, *_ in brute_contamination([(k, r["text"]) for k, r in enumerate(rows)], items)}
    want = Counter((r["doc_id"], found[k][0] - found[k][1]) for k, r in enumerate(rows) if not found[k][0] or found[k][1] < found[k][0])
    got = out.collect()
    assert Counter((r["doc_id"], len(word.findall((r["text"] or "").translate(LOWER)))) for r in got) == want
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got)
    assert 7006 not in {r["doc_id"] for r in got} and {7001, 7002, 7003} <= {r["doc_id"] for r in got}


def test_packing_by_row(spark, docs):
    from tokenizers import Tokenizer

    tokenizers = pytest.importorskip("public_tokenizers")
    got = STAGE["packing"](spark, docs, DATA).collect()
    plain = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in want.items())


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_of_nothing(spark, docs, name):
    assert STAGE[name](spark, docs.limit(0), DATA).count() == 0


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    kept = docs.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    assert kept.filter("quality = 0").count() == 0
    pieces = pipeline.STAGES[-1][1](spark, docs, DATA)
    whole = pipeline.run(spark, DATA)
    columns = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32")]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, pieces.select(*columns).collect()))

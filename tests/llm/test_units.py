"""The parts that need no session: hashing, codecs, solvers, parsers, models."""

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import fmindex, langid, lattice, minhash, packing, quality, sharding, templates, tokenfile, tokens, trees, words

public_tokenizers = pytest.importorskip("public_tokenizers")


def buffers(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_words_do_not_cross_texts():
    data, offsets = buffers(["Ab c", "", "d", " é\tX "])
    low, starts, stops, first = words.find(data, offsets, words.byte_class((0x20, 0x20), (0x09, 0x0D)))
    assert [low[a:b].tobytes().decode() for a, b in zip(starts, stops)] == ["ab", "c", "d", "é", "x"] and first.tolist() == [0, 2, 2, 3, 5]
    again = words.hashes(*words.find(*buffers(["zz c ab"]), words.byte_class((0x20, 0x20)))[:3])
    h = words.hashes(low, starts, stops)
    assert h[0] == again[2] and h[1] == again[1] and len(set(h.tolist())) == 5


def test_shingles_of_short_texts():
    data, offsets = buffers(["a b c d", "a b", "", "a b c"])
    low, starts, stops, first = words.find(data, offsets, words.byte_class((0x20, 0x20)))
    s, at = words.shingles(words.hashes(low, starts, stops), first, 3)
    assert at.tolist() == [0, 2, 3, 3, 4] and s[0] == s[3]


def test_slices_keep_whole_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 50, "", "z" * 3]})
    got = [(len(rows), data.tobytes(), offsets.tolist()) for rows, data, offsets in words.slices(batch.slice(1), "text", 20)]
    assert sum(n for n, _, _ in got) == 4 and b"".join(d for _, d, _ in got) == b"y" * 50 + b"zzz"


ODD = ["", None, " ", "a  b\n\n c ", "don't we'll 's ,'t x'", "a  b", "<|endoftext|> x", "é, ≮ ≠x", "x" * 300 + " 12 67,8%%% \r\n\t end\n", "né,e À* ª, ×a ²b é", "“q” – x", "a\x1c b \x85 c"]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_library(name, drops):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("ab'.,é×ß \n\t1ª́ <|>≠sS"), rng.integers(0, 40))) for _ in range(500)]
    codec = tokens.Encoder(public_tokenizers.path(name), drops)
    for texts in (ODD, made, made, [""]):
        ids, at = codec.encode(*buffers(texts))
        want = [e.ids for e in codec.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segments_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 32, n, dtype=np.uint64), rng.integers(0, 50000, n), np.full(n, 7), np.where(rng.random(n) < 0.05, 4_000_000_000, 3)):
        ids = ids.astype("<u4")
        cut = [n // 3, n - n // 3]
        docs, counts, back = tokenfile.decode_segment(tokenfile.encode_segment([5, None], np.array(cut), ids))
        assert docs == [5, None] and counts.tolist() == cut and (back == ids).all()
    with pytest.raises(ValueError):
        tokenfile.decode_segment(b"something else")


def test_percentile_width_patches_outliers():
    ids = np.full(512, 10, "<u4")
    ids[3] = 4_000_000_000
    assert len(tokenfile.encode_segment([1], np.array([512]), ids)) < 200


@pytest.mark.parametrize("n", [0, 1, 7, 300, 4000])
def test_patterns_hold_every_item(n):
    rng = np.random.default_rng(n)
    width = rng.integers(1, 65, n)
    demand = np.bincount(width, minlength=65)[1:]
    plan = packing.patterns(demand, 64)
    assert (sum((c * v for c, v in plan), np.zeros(64, int)) == demand).all()
    assert all((v * np.arange(1, 65)).sum() <= 64 for _, v in plan)
    bins = sum(c for c, _ in plan)
    assert bins <= 1.03 * width.sum() / 64 + 3
    table = packing.slots(plan)
    assert len(table) == 0 or table.groupby("cls").lo.min().eq(0).all()


def test_price_is_the_best_knapsack():
    gains = np.array([0.0, 0.5, 0.8, 1.0])
    best = max(sum(gains[w - 1] for w in c) for k in range(1, 6) for c in __import__("itertools").combinations_with_replacement(range(1, 5), k) if sum(c) <= 9)
    value, counts = packing.price(gains, 9)
    assert abs(value - best) < 1e-12 and (counts * np.arange(1, 5)).sum() <= 9


def test_tree_is_balanced_and_gives_the_tightest():
    rng = np.random.default_rng(8)
    rooms, held = trees.Rooms(), []
    for k in range(3000):
        if len(held) < 5 or rng.random() < 0.6:
            key = (int(rng.integers(0, 500)), k)
            rooms.add(key)
            held.append(key)
        else:
            size = int(rng.integers(0, 520))
            want = min((h for h in held if h[0] >= size), default=None)
            assert rooms.tightest(size) == want
            if want:
                held.remove(want)

    def check(t):
        if not t:
            return 0, []
        (a, x), (b, y) = check(t[0]), check(t[2])
        assert abs(a - b) <= 1 and t[3] == 1 + max(a, b)
        return t[3], [*x, t[1], *y]

    assert check(rooms.tree)[1] == sorted(held)


def test_best_fit_against_brute_force():
    """Every run placed as one item after another, each in the tightest bin that holds it."""
    rng = np.random.default_rng(12)
    for _ in range(20):
        sizes = sorted(((int(s), int(n)) for s, n in zip(*np.unique(rng.integers(1, 60, 80), return_counts=True))), reverse=True)
        capacity = int(rng.integers(400, 700))
        room, want = [capacity] * 6, []
        for s, n in sizes:
            for _ in range(n):
                fits = [k for k in range(6) if room[k] >= s]
                if not fits:
                    want = None
                    break
                k = min(fits, key=lambda k: (room[k], k))
                room[k] -= s
                want.append((s, k))
            if want is None:
                break
        got = sharding.best_fit(sizes, 6, capacity)
        assert (got is None) == (want is None)
        if got:
            assert [(s, k) for s, n, k in got for _ in range(n)] == want


def test_best_fit_is_even_and_whole():
    rng = np.random.default_rng(1)
    sizes = [(int(s), int(n)) for s, n in zip(*np.unique(rng.integers(8, 5000, 3000), return_counts=True))]
    steps = sharding.plan(sizes, 24)
    total = {}
    placed = {}
    for s, n, shard in steps:
        total[shard] = total.get(shard, 0) + s * n
        placed[s] = placed.get(s, 0) + n
    assert placed == dict(sizes) and len(total) == 24 and max(total.values()) <= 1.005 * min(total.values())
    whale = sharding.plan([(10_000_000, 1), *sizes], 24)
    rest = {}
    for s, n, shard in whale:
        rest[shard] = rest.get(shard, 0) + s * n
    assert max(rest.values()) == 10_000_000 and sorted(rest.values())[-2] <= 1.01 * min(rest.values())
    assert sharding.plan([], 24) == []


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    near, second = lattice.decode(x)
    for points in (near, second):
        assert ((points % 2 == 0).all(axis=1) | (points % 2 == 1).all(axis=1)).all() and (points.sum(axis=1) % 4 == 0).all()
    d1, d2 = (((p / 2 - x) ** 2).sum(axis=1) for p in (near, second))
    assert (d1 <= d2 + 1e-9).all() and (d1 <= 1 + 1e-9).all() and (near != second).any(axis=1).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_and_estimate_catch_pairs_at_the_threshold(percent):
    """Pairs of sets of just the threshold's similarity: the share that a band and the estimate lead to."""
    rng, tried, union = np.random.default_rng(percent), 1500, 200
    common, texts = union * percent // 100, []
    alone = (union - common) // 2
    for _ in range(tried):
        w = rng.choice(1 << 40, union, replace=False)
        texts += [" ".join(map(str, w[: common + alone])), " ".join(map(str, [*w[:common], *w[common + alone :]]))]
    out = next(iter(minhash._signatures(1, *minhash.banding(percent))([pa.RecordBatch.from_pydict({"_id": list(range(2 * tried)), "text": texts})])))
    key = np.array(out.column(5).to_pylist())
    assert (key[::2] == key[1::2]).any(axis=1).mean() >= 0.999
    sig = np.array(out.column(4).to_pylist(), dtype=np.int64).view(np.uint64)
    x = sig[::2] ^ sig[1::2]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    alike = (1 - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1) / minhash.PERMUTATIONS - 1 / 16) / (15 / 16)
    assert abs(alike.mean() - percent / 100) < 0.01 and (alike >= percent / 100 - minhash.SLACK).mean() >= 0.999


def test_lattice_cells_catch_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((1500, 64))
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * u

    def cells(z):
        column = pa.FixedSizeListArray.from_arrays(pa.array(z.reshape(-1)), 64).cast(pa.list_(pa.float64()))
        out = next(iter(lattice._cells(64)([pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), column], names=["id", "v"])])))
        got = {}
        for c, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got.setdefault(i, set()).add(c)
        return got

    a, b = cells(x), cells(y)
    assert np.mean([bool(a[i] & b[i]) for i in a]) > 0.995


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5, 400)
    text[-1] = 0
    index = fmindex.FMIndex(text)
    for _ in range(100):
        n = int(rng.integers(1, 6))
        phrase = rng.integers(1, 5, n)
        lo, hi = index.search(phrase[None, :], np.array([n]))
        want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == phrase).all()]
        assert hi[0] - lo[0] == len(want) if want else hi[0] <= lo[0]
        if want:
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


PAGES = {
    "comments": ('<html><body><header><div>Site</div></header><div class="wrap"><main><h1>T</h1><p>One &amp; two<p>Three<div class="comments"><p>nice</p></div><aside>x</aside></main></div><div class="cookie-notice">We use</div><script>if(a<b){"</p>"}</script></body></html>', "T\nOne & two\nThree"),
    "no article": ('<body><div id="menu"><a>x</a></div><div><h2>H</h2>para one <b>bold</b> text<br>more<ul><li>it <a href=#>x</a></li><li>two</li></ul></div><form><input><p>no</p></form><footer>f</footer>', "H\npara one bold text more\nit x\ntwo"),
    "article header": ('<article><header><h1>T</h1></header><p>x</p><footer>tags</footer><section class="related"><a>q</a></section></article><article class="comment"><p>c</p></article>', "T\nx"),
    "plain": ("just text &lt;b&gt; here\n\n and", "just text <b> here and"),
    "empty": ("", ""),
    "comment to the end": ("<article><p>a<!-- c", "a"),
    "quotes": ('<article><p title="a>b">x</p><p title=don\'t>y</p><table><tr><td>1<td>2<tr><td>3</table></article>', "x\ny\n1\n2\n3"),
    "stray signs": ("<article><p>1 < 2 and 3>2 &nbsp; x<p/>y</article", "1 < 2 and 3>2 x\ny"),
    "hidden": ('<body><article><p>a</p><p style="display: none">b</p><p hidden>c</p></article>', "a"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_text(name):
    html, text = PAGES[name]
    assert templates.Page(html).text(set()) == text


def test_deep_and_broken_pages_are_linear():
    assert templates.Page("<div>" * 50_000 + "x").text(set()) == "x"
    templates.Page("<a href='" * 20_000)


def test_templates_leave_article_paragraphs():
    page = templates.Page("<body><div>Promo of the site</div><article><p>Shared passage</p><div>Share this story</div></article></body>")
    every = set(page.hash)
    assert page.text(every & page.candidates()) == "Shared passage"


def test_discriminant_separates_and_degenerates():
    rng = np.random.default_rng(5)
    f = {c: rng.normal(c * 3, 1 + c, (300, quality.FEATURES)) for c in (0, 1)}
    sums = {}
    for c, x in f.items():
        own = np.column_stack([np.ones(len(x)), x])
        sums[c] = own.T @ own
    model = quality.Discriminant(sums)
    assert (model.score(f[1]) > 0.5).mean() > 0.99 and (model.score(f[0]) < 0.5).mean() > 0.99
    # The score written out: Gaussian densities by determinant and inverse of the shrunk covariances.
    means, n = {c: f[c].mean(axis=0) for c in f}, quality.FEATURES
    own = {c: np.cov(f[c].T, bias=True) for c in f}
    shrunk = {c: (1 - quality.DIAGONAL - quality.POOLED) * own[c] + quality.DIAGONAL * np.diag(np.diag(own[c])) + quality.POOLED * (own[0] + own[1]) / 2 + quality.FLOOR * np.eye(n) for c in f}
    x = np.concatenate([f[0], f[1], rng.normal(1.5, 2, (50, n))])

    def density(c):
        d = x - means[c]
        return np.log(0.5) - 0.5 * np.log(np.linalg.det(shrunk[c])) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(shrunk[c]), d)

    want = 1 / (1 + np.exp(np.clip(density(0) - density(1), -700, 700)))
    assert np.allclose(model.score(x), want, atol=1e-9)
    nothing = np.zeros((quality.FEATURES + 1,) * 2)
    assert (quality.Discriminant({0: nothing, 1: nothing}).score(f[0]) == 0.5).all()
    assert (quality.Discriminant({0: nothing, 1: sums[1]}).score(f[0]) == 1).all()


def test_language_counts_do_not_cross_texts():
    both = langid.counts(*buffers(["Ab", "CD", "", "É"]))
    apart = np.concatenate([langid.counts(*buffers([t])) for t in ("ab", "cd", "", "é")])
    assert (both == apart).all() and both[2].sum() == 0

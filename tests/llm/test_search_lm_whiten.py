import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.llm import lattice_lm, queries, sketch_search, whiten
from tests.llm.cases import CLASHING, DOCS, SMALL, edge, edge_rows, empty, small  # noqa: F401

# --- ranked lexical search --------------------------------------------------------------


def terms_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def ranked(rows, items, k=10):
    """rows: (doc_id, text); items: (item_id, text). (item_id, rank, doc_id, score)."""
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in docs)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_is_brute_force(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_sketch_search"](spark, SMALL)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == order(ranked([r[:2] for r in small], items))


@pytest.mark.parametrize("k, cells", [(1, 1 << 21), (3, 200), (100, 64)])
def test_search_edges(spark, edge, monkeypatch, k, cells):
    """Nulls, ties, repeated rows and queries, blocks of any size, terms above the sketch's largest frequency."""
    monkeypatch.setattr(sketch_search, "BLOCK_CELLS", cells)
    monkeypatch.setattr(sketch_search, "QUERIES", 2)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(20, "line " * 300 + "many"), (21, "LINE line"), (22, "Line-line"), (23, "...")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS).repartition(5)
    items = [(1, "this line, is SHARED by"), (2, None), (3, "!!"), (None, "every word 日本語"), (1, "line"), (5, "absent"), (6, "line")]
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = sketch_search.search(docs.withColumns({c: F.lit("x") for c in CLASHING}), q, k=k)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == order(ranked(rows, items, k))


def test_search_empty(spark, empty):
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sketch_search.search(empty, q).count() == 0
    assert sketch_search.search(q.select(F.col("item_id").alias("doc_id"), "text"), q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_bounds(spark):
    """No document's score is above its bound, collisions or not."""
    q = sketch_search.Queries([(1, {sketch_search.term_hash(t) for t in (b"a", b"b", b"c")})],
                              {sketch_search.term_hash(t): 2 for t in (b"a", b"b", b"c")}, 10, 1000, 1)
    for tf in ([1, 5, 300], [0, 0, 1], [254, 255, 256]):
        words = dict(zip((b"a", b"b", b"c"), tf)) | {str(i).encode(): 1 + i % 7 for i in range(200)}
        h = {sketch_search.term_hash(w): n for w, n in words.items() if n}
        width = 64
        sketch = np.zeros(width, dtype=np.uint8)
        for x, n in h.items():
            sketch[x % width] = max(sketch[x % width], min(n, 255))
        n = np.array([sum(h.values())])
        bound = (sketch_search._impacts(sketch[None, :], q.normal(n)) @ q.matrix(width))[0, 0]
        m = 8 * int(q.normal(int(n[0])))
        assert bound >= sum(q.weight[x] * (10 ** 9 * h[x] // (1000 * h[x] + m)) for x in q.hashes[0] if x in h) > 0


# --- language model ---------------------------------------------------------------------

PIECES = [("▁", -3.0), ("▁t", -2.0), ("▁the", -1.0), ("▁an", -2.0), ("t", -2.0), ("h", -2.5), ("e", -1.5), ("he", -2.0),
          ("re", -2.0), ("r", -3.0), ("a", -2.0), ("n", -2.0), ("and", -2.5), ("d", -2.0), ("ü", -5.0)]


@pytest.fixture(scope="module")
def vocabulary():
    return lattice_lm.Vocabulary(PIECES, [-6.0] * 256, -1.0)


def segmentations(v, word, at=0):
    """All lists of slots that spell ``word``."""
    if at == len(word):
        yield [0]
        return
    for end in range(at + 1, len(word) + 1):
        p = word[at:end]
        if p in v.inner:
            yield from ([v.inner[p], *s] for s in segmentations(v, word, end))
        elif len(p) == 1:
            yield from ([*(v.bytes + b for b in p.encode()), *s] for s in segmentations(v, word, end))


def all_ways(v, word):
    yield from ([v.starts[""], *s] for s in segmentations(v, word))
    for p, slot in v.starts.items():
        if p and word.startswith(p):
            yield from ([slot, *s] for s in segmentations(v, word[len(p):]))


WORDS = ["the", "there", "and", "an", "t", "thé", "ünd", "andandthere", "日本", "a" * 300, "the" * 120]


def test_marginals_are_sums_over_all_segmentations(vocabulary):
    logs = vocabulary.logs(vocabulary.first_mass())
    lattice = lattice_lm.Lattice(vocabulary, logs)
    got = lattice.marginals(WORDS)
    for w, x in zip(WORDS, got):
        assert math.isclose(x, lattice.long_marginal(w), rel_tol=1e-12)
        if len(w) < 20:
            assert math.isclose(x, math.log(sum(math.exp(sum(logs[s] for s in way)) for way in all_ways(vocabulary, w))), rel_tol=1e-12)


def test_expected_uses(vocabulary):
    """Expected uses are the segmentations' uses weighted by their shares, and another round never lowers the likelihood."""
    words = [w for w in WORDS if len(w) < 20]
    logs = vocabulary.logs(vocabulary.first_mass())
    mass = np.zeros(vocabulary.size)
    lattice_lm.Lattice(vocabulary, logs).add_expected(words, mass)
    want = np.zeros(vocabulary.size)
    for w in words:
        ways = [(math.exp(sum(logs[s] for s in way)), way) for way in all_ways(vocabulary, w)]
        for p, way in ways:
            np.add.at(want, way, p / sum(x for x, _ in ways))
    assert np.allclose(mass, want, rtol=1e-9)
    better = lattice_lm.Lattice(vocabulary, vocabulary.logs(mass + 1e-9)).marginals(words).sum()
    assert better > lattice_lm.Lattice(vocabulary, logs).marginals(words).sum()


def test_word_probabilities_add_to_at_most_one(vocabulary):
    from itertools import product
    lattice = lattice_lm.Lattice(vocabulary, vocabulary.logs(vocabulary.first_mass()))
    words = ["".join(p) for n in range(1, 6) for p in product("thearn", repeat=n)]
    assert 0.1 < np.exp(lattice.marginals(words)).sum() <= 1


def by_hand(rows, vocabulary, rounds):
    """rows: (doc_id, text). (held_out, n_tokens, n_known, train_tokens, base, score) of each row."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    count, ends = Counter(w for ws, h in zip(words, held) if not h for w in ws), held.count(False)
    n, distinct = sum(count.values()) + ends, len(count) + (ends > 0)
    own = vocabulary.first_mass()
    logs = vocabulary.logs(own)
    for _ in range(rounds):
        mass = np.zeros(vocabulary.size)
        lattice_lm.Lattice(vocabulary, logs).add_expected([w.decode() for w in count], mass)
        logs = vocabulary.logs(mass + own)
    lattice = lattice_lm.Lattice(vocabulary, logs)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    v = distinct + (ends == 0)
    out = []
    for h, ws in zip(held, words):
        base = score = 0.0
        for w in [*ws, None]:
            c = ends if w is None else count[w]
            base += math.log10((c + 0.1) / (n + 0.1 * (distinct + 1)))
            p = (ends + 1 - d) / (n + 1) if w is None else \
                max(c - d, 0) / (n + 1) + d * v / (n + 1) * math.exp(lattice.long_marginal(w.decode()))
            score += math.log10(p)
        out.append((h, len(ws) + 1, sum(count[w] > 0 for w in ws) + (ends > 0), n, base, score))
    return out


@pytest.mark.parametrize("frequent", [0, 40, 1 << 17])
def test_scores_by_hand(spark, edge, vocabulary, frequent):
    """Every path of a word (held by tasks, joined, unseen) gives the same sums; nulls, repeats and long texts too."""
    rows = [r[:2] for r in edge_rows()] + [(i, f"there and the {'an ' * (i % 4)} x{i % 3}\x0b.") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = lattice_lm.score(docs.repartition(3), vocabulary, rounds=2, frequent_words=frequent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 5))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    want = sorted(((i, *x) for (i, _), x in zip(rows, by_hand(rows, vocabulary, 2))), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_scores_without_training_texts(spark, empty, vocabulary):
    assert lattice_lm.score(empty, vocabulary).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lattice_lm.score(spark.createDataFrame([(held, "the end")], "doc_id long, text string"), vocabulary).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and math.isfinite(r["score"]) and r["score"] < 0


def test_known_text_is_likelier_than_noise(spark):
    got = queries.QUERIES["op12_lattice_lm"](spark, SMALL).where("held_out").agg(
        F.avg(F.col("score") / F.col("n_tokens")).alias("text")).first()["text"]
    vocabulary = lattice_lm.read_vocabulary(queries.vocabulary_path())
    lattice = lattice_lm.Lattice(vocabulary, vocabulary.logs(vocabulary.first_mass()))
    noise = lattice.marginals(["qzxv", "wjkqp", "xxqzj"]) / math.log(10)
    assert noise.max() < got < 0


# --- whitening --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def by_numpy(rows, components=8):
    """rows: (vec_id, vector), all usable. Exact sums in whole numbers."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    cov = np.array([[v / (n * n) for v in r] for r in (n * x.T.dot(x) - np.outer(s, s)).tolist()])
    e, u = np.linalg.eigh(cov)
    at = np.argsort(-e)[:components]
    w = ((n * x - s) / n).astype(float) @ u[:, at] / np.sqrt(e[at])
    return w, ((n * x - s) ** 2).sum(axis=1), e[at] / np.trace(cov)


@pytest.mark.parametrize("bits", [0, 1, 7, 30, 40])
def test_bit_planes_give_exact_products(bits):
    rng = np.random.default_rng(bits)
    y = rng.integers(0, 1 << bits, (150, 5), endpoint=True)
    y[:, 3] = 0
    want = y.astype(object).T.dot(y.astype(object))
    assert (whiten.cross_products(y) == want).all()
    assert (whiten.cross_products(y.astype(object) << 30) == want << 60).all()


@pytest.mark.parametrize("size", [1.0, 1e3, 1e9, 1e40])
def test_whitened(spark, monkeypatch, size):
    """Blocks, tasks and sizes of entries change nothing but the last bits."""
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10)) * size + size
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(7, [float(c) for c in x[7]]), (None, [float(c) for c in x[8]])]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [None] * 10, 1), (1003, [math.nan] + [0.0] * 9, 1), (1004, [math.inf] * 10, 1), (1005, [1.0], 1)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows] + bad, VECTORS).withColumns({c: F.lit("x") for c in CLASHING if c != "label"})
    got = whiten.whiten(df.repartition(7)).collect()
    w, deviation, share = by_numpy(rows)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {len(rows)}
    sign = {}
    for r in got:
        if r["vec_id"] == 0:
            sign[r["component"]] = np.sign(r["whitened"] * w[0, r["component"] - 1])
    for r in got:
        if r["vec_id"] not in (7, 8, None):
            assert math.isclose(r["whitened"] * sign[r["component"]], w[r["vec_id"], r["component"] - 1], rel_tol=1e-7, abs_tol=1e-7)
            if size < 1e9:
                assert int(r["deviation"]) == deviation[r["vec_id"]]
        assert math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-8


def test_without_variance(spark):
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1)], VECTORS)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == \
        [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whiten.whiten(spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.5, 2.0], 1)], VECTORS)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert flat[0]["identity_error"] < 1e-12
    assert whiten.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None, 1), (2, [], 2)], VECTORS)).count() == 0


def test_whiten_query(spark):
    got = queries.QUERIES["op13_whiten_bitslice"](spark, SMALL)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = {(r["vec_id"], r["component"]): r for r in got.collect()}
    good = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
            if r["embedding"] and all(v is not None and math.isfinite(v) for v in r["embedding"])]
    w, deviation, _ = by_numpy(good)
    assert len(rows) == 8 * len(good)
    assert [rows[i, 1]["deviation"] for i, _ in good] == deviation.tolist()
    assert max(r["identity_error"] for r in rows.values()) < 1e-4

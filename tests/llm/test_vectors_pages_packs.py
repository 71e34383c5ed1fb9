"""Embedding links, classifier, extraction, packing and sharding."""

import zlib

import brute
import duckdb
import numpy as np
import pytest
from cases import SMALL, edge, edge_rows, empty, small  # noqa: F401 (fixtures)

from ordertide.llm import embed_forest, html_tree, packing, pu_classifier, queries, shard_tree

VECTORS = "vec_id long, embedding array<float>, label int, cid string, dim string, members string, codes string"


def vectors():
    rng = np.random.default_rng(5)
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [float("nan")] + [1.0] * 7, 1), (5, [float("inf")] + [1.0] * 7, 1),
            (6, [None] + [1.0] * 7, 1), (7, [1.0] * 8, None), (8, [1.0] * 8, None), (9, [1.0] * 8, 1), (9, [1.0] * 8, 1),
            (None, [1.0] * 8, 1), (10, [3.0] * 8, 1), (11, [1.0] * 7, 1), (12, [1e38] * 8, 1), (13, [-0.0] + [1.0] * 7, 2),
            (14, [0.0] + [1.0] * 7, 2), (15, [1e-30] * 8, 1)]
    at = 20
    for _ in range(12):  # clusters of near copies, one of them large
        centre = rng.standard_normal(8)
        for _ in range(4 if at > 80 else 60):
            rows.append((at, (centre + 0.12 * rng.standard_normal(8)).tolist(), 3))
            at += 1
    return [(i, e if e is None else [None if v is None else float(np.float32(v)) for v in e], x) for i, e, x in rows]


@pytest.mark.parametrize("options", [dict(), dict(leaf_rows=8, trees=8), dict(leaf_rows=16, block_rows=5, trees=8),
                                     dict(leaf_rows=4, sample_rows=40, trees=10, spill=1.5)])
def test_links_are_all_links(spark, options):
    rows = vectors()
    d = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS).repartition(3)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embed_forest.link(d, **options).collect()]
    want = [(r[0], *x) for r, x in zip(rows, brute.cosine_links(rows))]
    if not options or "block_rows" in options:
        assert sorted(map(str, got)) == sorted(map(str, want))
    else:  # smaller leaves may miss links near the threshold, and may invent none
        assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
        most = {w[0]: w[1] for w in want}
        assert all(g[1] <= most[g[0]] for g in got)


def test_links_small(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SMALL}/embeddings.parquet'").fetchall()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op3_embed_forest(spark, SMALL).collect()}
    assert got == {r[0]: (n, c, c == r[0]) for r, (n, c) in zip(rows, brute.cosine_links(rows))}


def test_recall_where_leaves_are_small(spark):
    """Pairs close to the threshold, with leaves far smaller than the labels."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 64))
    y = x + 0.36 * rng.standard_normal((1500, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    got = embed_forest.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf_rows=128)
    want = brute_links = 0
    u = np.concatenate([x, y])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    brute_links = int((u @ u.T >= 0.93).sum() - len(u))
    want = sum(r["n_links"] for r in got.collect())
    assert brute_links > 1000 and 0.95 * brute_links <= want <= brute_links


def test_deep_trees_copy_a_vector_a_few_times():
    """Copies a tree level off with its depth, and trees follow the rows."""
    rng = np.random.default_rng(7)
    x = embed_forest.unit(rng.standard_normal((8192, 64)))
    margin = np.sqrt(2 - 2 * 0.93) / 8

    def copies(leaf_rows, decay):
        rows, codes = embed_forest.Tree(x, len(x), 0, leaf_rows, margin, decay, 42).leaves(x)
        assert len(np.unique(rows)) == len(x) and codes.dtype == np.int32
        return len(rows) / len(x)

    assert copies(64, 0.75) < 3.2 < copies(128, 1.0)
    trees = [embed_forest.trees_for(10 ** k, 2048, 0.93, 1.0, 0.75, 0.99) for k in range(3, 10)]
    assert trees == sorted(trees) and trees[0] == embed_forest.MIN_TREES and trees[-1] <= 40


def test_no_vectors(spark):
    assert embed_forest.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, None, 1)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in embed_forest.link(nothing).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_pu_classifier(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    out = [(got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert len(out) > 80 and sum(a == b for a, b in out) >= 0.97 * len(out)


def test_classifier_reads_no_held_out_label(spark):
    """Other labels on held-out rows change no score, and negatives are not read."""
    docs, labels = (queries.read_corpus(spark, SMALL, n) for n in ("documents", "labels"))
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(pu_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    fewer = other.where("quality = 1")
    scores = [sorted((r["doc_id"], r["score"]) for r in pu_classifier.classify(docs, x).collect()) for x in (labels, other, fewer)]
    assert scores[0] == scores[1] == scores[2]


def test_class_prior_and_risk():
    rng = np.random.default_rng(0)
    n = 4000
    p, good = rng.normal(2, 1, n), rng.random(n) < 0.7
    u = np.where(good, rng.normal(2, 1, n), rng.normal(-2, 1, n))
    assert abs(pu_classifier.class_prior(p, u) - 0.7) < 0.06
    x = lambda v: np.stack([v, np.ones_like(v)], axis=1)
    w = pu_classifier.non_negative_risk(x(p), x(u), 0.7, 1e-4, 300, 0.05)
    assert ((x(u) @ w > 0) == good).mean() > 0.95


def test_classifier_edges(edge, empty):
    spark = edge.sparkSession
    labels = spark.createDataFrame([(1, 1), (5, 1), (9, 1), (8, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = pu_classifier.classify(edge, labels, carry=("text", "source"))
    rows = got.collect()
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in rows) == sorted(str((r[0], r[1], r[3])) for r in edge_rows())
    blank = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(blank) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in pu_classifier.classify(edge, none).collect()} == {0.5}
    assert pu_classifier.classify(empty, labels).count() == 0


ARTICLE = "<p>First paragraph, with some text that goes on, and on.<p>Second &eacute; &#233; a < b, x &lt; y.</p>"
CHROME = ('<header><p>Site, name, and a slogan that is long enough to count, too</p></header><nav><a href="/">Home</a></nav>'
          '<div id="cookie-notice">We use cookies, and more cookies, for every purpose, always.</div>')
AFTER = ('<div class="sidebar"><p>Read this, too, it is about something else, at length.</p></div><section id="comments">'
         '<p>Nice article, I like it, really, very much, and I say so in many words.</p></section><footer>(c), 2020</footer>')
WANT = "First paragraph, with some text that goes on, and on.\nSecond é é a < b, x < y."


@pytest.mark.parametrize("page, text", [
    (f"<html><body>{CHROME}<article><h1>Title</h1>{ARTICLE}</article>{AFTER}</body></html>", "Title\n" + WANT),
    (f"<body>{CHROME}<div class='wrap'><div id='content'><h2>Title</h2>{ARTICLE}<form><label>Name</label><input></form>"
     f"</div>{AFTER}</div>", "Title\n" + WANT),
    (f"{CHROME}<main><div><div>{ARTICLE}</div></div><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>"
     f"</main>{AFTER}", WANT),
    ("<article><p><b>Unclosed.<br>next</article><footer>more, and more, and more, and still more</footer>", "Unclosed. next"),
    ("<article><p>a  b\n\tc</p><blockquote>q</blockquote><table><tr><td>1<td>2</table><ul><li>x<li>y</ul><pre>k\n l</pre></article>",
     "a b c\nq\n1\n2\nx\ny\nk l"),
    ("<script>var a='</p><p>no'; if (a<b) c();</script><style>p{}</style><p>yes<!-- <p>no --> it is", "yes it is"),
    ("<p style='display: none'>no</p><p hidden>no</p><div class=\"ad-slot\">no</div><p>yes", "yes"),
    ("just text", "just text"), ("", ""), (None, ""), ("<html><body></body></html>", ""), ("<p>cut <a href='x", "cut <a href='x"),
    ("<div " + "<" * 50 + ">x", None), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
])
def test_main_text(page, text):
    got = html_tree.main_text(page)
    assert got == text if text is not None else isinstance(got, str)


LONG_P = "<p>A long paragraph, with commas, and clauses, and so many words that nobody takes it for a menu, or for an advert.</p>"


@pytest.mark.parametrize("page, held, gone", [
    (f"<div class='content has-sidebar'>{LONG_P * 3}<div class='sidebar'><p>Read this, too.</p></div></div>", ["A long"], ["Read this"]),
    (f"<div class='social'>{LONG_P}</div>", ["A long"], []), (f"<div class='cookie'>{LONG_P}</div>", ["A long"], []),
    (f"<article>{LONG_P}<section id='related-work'><h2 id='social-factors'>Work</h2>{LONG_P * 2}</section></article>",
     ["A long", "Work"], []),
    (f"{CHROME}<article class='post tags-x'><h1>Title</h1>{LONG_P}</article>{AFTER}", ["Title", "A long"], ["Nice", "cookies", "Read"]),
    (f"<article><h1>T</h1><p class='byline'>By A. Writer</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, as we said.</p>{LONG_P}"
     "</article>", ["By A. Writer", "So x=2, as we said."], []),
    (f"<article>{LONG_P}<div class='related'><a href=a>One more</a><a href=b>Two more</a></div></article>", ["A long"], ["more"]),
    (f"<article>{LONG_P}<div id='comments'><ol><li class='comment'><article class='comment-body'>{LONG_P.replace('A long', 'My')}"
     f"</article></ol></div></article>", ["A long"], ["My par"]),
    (f"<article>{LONG_P}</article><div id='comments'><article class='comment-body'>{LONG_P.replace('A long', 'My') * 4}</article></div>",
     ["A long"], ["My par"]),
])
def test_names_alone_drop_no_text(page, held, gone):
    got = html_tree.main_text(page)
    assert all(x in got for x in held) and not any(x in got for x in gone)


STORY = "<h1>The title</h1>" + LONG_P + LONG_P.replace("A long", "Another") + LONG_P.replace("A long", "A third")
SHORT = "<p>Well said, and so true, I think, my friend.</p>"


@pytest.mark.parametrize("page, held, gone", [
    (f"<article>{STORY}</article><div class='discussion'><h2>12 responses</h2>{SHORT * 3}</div>", ["Another"], ["responses", "Well"]),
    (f"<main><article>{STORY}</article><article class='card'><h2>Other story</h2><p>Teaser, with a few words, and no more.</p></article>"
     "</main>", ["The title", "A third"], ["Other", "Teaser"]),
    (f"<article>{STORY}<h2>References</h2><ul><li><a href=a>First source</a><li><a href=b>Second source</a><li><a href=c>Third source"
     "</a></ul></article>", ["References", "First source\nSecond source\nThird source"], []),
    (f"<article>{LONG_P}<aside class='pullquote'>Nobody takes it for a menu.</aside>{LONG_P}<aside>Side</aside>"
     "<aside class='related'>More</aside></article>", ["Nobody takes it for a menu."], ["Side", "More"]),
    (f"<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td><td>{STORY}</td></tr></table>", ["The title", "A third"], ["Home"]),
    ("<div><h1>Title</h1><p>Short.</p></div><div class='box'><p>One longer sentence, which is about something else.</p></div>",
     ["Title\nShort."], ["One longer"]),
    (f"<div><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul>{STORY}<ul><li><a href=a>Go</a><li><a href=b>On"
     "</a><li><a href=c>Reading</a></ul></div>", ["Another"], ["Home", "Reading"]),
    (f"<main><article>{STORY}</article><article>{STORY.replace('title', 'second')}</article></main>", ["The title", "The second"], []),
])
def test_the_tree_decides(page, held, gone):
    got = html_tree.main_text(page)
    assert all(x in got for x in held) and not any(x in got for x in gone)


@pytest.mark.parametrize("tag", "svg object canvas noscript template select audio video".split())
def test_unclosed_elements_hide_nothing(tag):
    assert html_tree.main_text(f"<body><{tag}>no</{tag}><{tag}><article>{LONG_P}</article></body>") == LONG_P[3:-4]
    assert html_tree.main_text(f"<article>{LONG_P}<script>var a; <p>no</p></article>") == LONG_P[3:-4]


def test_pages(spark):
    """On the given pages: the blocks of the article element, read by patterns."""
    import html
    import re
    got = {r["page_id"]: r for r in queries.op8_html_tree(spark, SMALL).collect()}
    for i, url, page in duckdb.sql(f"SELECT page_id, url, html FROM '{SMALL}/pages.parquet'").fetchall():
        inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in blocks if x)
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, want, len(want))


def test_pages_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, "", "x"), (2, "v", "<p>" + "long, " * 100_000, "x")]
    out = html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(str((r["page_id"], r["n_chars"])) for r in out) == sorted(["(1, 0)", "(1, 1)", "(1, 1)", "(None, 0)", "(2, 599999)"])
    assert html_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def _check_packed(rows, capacity):
    """Pieces stand without gaps in sequences of at most ``capacity`` ids."""
    end = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
        assert end[r["sequence_id"]] <= capacity
    return len(end)


def test_pack_round_trip(spark, small):
    """Packed sequences, cut at their pieces, are the documents' ids again."""
    docs = queries.read_corpus(spark, SMALL, "documents")
    packed = packing.pack(packing.tokenize(docs, queries.tokenizer_path(), capacity=1000), capacity=1000)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    rows = packed.collect()
    n = _check_packed(rows, 1000)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 1000 + 2
    ids = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    t = _tokenizer()
    for i, text, _ in small:
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        back = np.concatenate([ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] for r in parts])
        assert back.tolist() == t.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r["start"] for r in parts] == list(range(0, len(back), 1000))


def test_words_are_encoded_alike(spark):
    """Odd words: marks, digits, accents, combining signs, the mark between words."""
    text = ("Don't STOP... it's 'tis 3.14 a1b2 naïve Ñandú été x\x01y \x01 \x01 日本語 🙂🙂 'll't (a|b) #tag ***a*** "
            "İstanbul ΑΣ ß don't!! d'oh <|endoftext|x <b> 100% a b c d\x1ce \x85f ,.;: ,,")
    cache, t = packing.WordCache(_tokenizer()), _tokenizer()
    for _ in range(2):
        assert np.frombuffer(cache.ids(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pack_edges(edge, empty):
    pieces = packing.tokenize(edge, queries.tokenizer_path(), capacity=64)
    rows = packing.pack(pieces.drop("ids"), capacity=64).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in edge_rows()}
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert sum(r["doc_id"] == 6 and r["piece"] == 0 for r in rows) == 2
    assert _check_packed(rows, 64) >= sum(r["length"] for r in rows) / 64
    assert packing.pack(packing.tokenize(empty, queries.tokenizer_path())).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_tight(seed):
    """Every piece has a place, and sequences are few."""
    rng = np.random.default_rng(seed)
    lengths = [np.full(50, 4096), rng.integers(1, 4097, 3000), rng.integers(2000, 2100, 3000), rng.integers(1300, 1400, 999),
               np.minimum(4096, np.exp(rng.normal(6.5, 1.2, 5000)).astype(int) + 1), np.array([1])][seed]
    n, c = np.unique(lengths, return_counts=True)
    histogram = dict(zip(n.tolist(), c.tolist()))
    p = packing.plan(histogram, 4096)
    used = {}
    for k, (length, rank, first, offset) in enumerate(zip(*(p[x].tolist() for x in ("length", "rank", "sequence", "offset")))):
        last = k + 1 == len(p["length"]) or p["length"][k + 1] != length
        count = (histogram[length] if last else int(p["rank"][k + 1])) - rank
        for s in range(first, first + count):
            used.setdefault(s, []).append((offset, length))
    assert sum(len(x) for x in used.values()) == len(lengths) and sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    ordered, rooms = sorted(lengths.tolist(), reverse=True), []
    for x in ordered:  # best fit, one by one
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            i = min(fits, key=rooms.__getitem__)
            rooms[i] -= x
        else:
            rooms.append(4096 - x)
    assert len(used) <= 1.01 * len(rooms) + 1


def test_configurations_cover_few_sizes():
    """600 + 400 and 300 + 700: two sizes a sequence, none left over."""
    found = packing.configurations([700, 600, 400, 300], [50, 80, 80, 50], 1000)
    assert sum(times for _, times in found) == 130
    assert all(a @ np.array([700, 600, 400, 300]) == 1000 for a, _ in found)


def test_shards(spark, edge, empty):
    got = queries.op10_shard_tree(spark, SMALL).collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    text = dict(rows)
    for r in got:
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 8, zlib.crc32(b), "key")
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    for out in (got, shard_tree.shard(edge, shard_tree.balanced_tree(5)).collect()):
        slots = {}
        for r in out:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(got) == len(rows) and shard_tree.shard(empty, shard_tree.balanced_tree(5)).count() == 0


def test_shards_by_hand(spark, edge):
    """Every shard, with 24 and with 25, from a plain descent of the tree; uneven trees and null ids too."""
    tree = shard_tree.balanced_tree(queries.SHARDS)
    for r in queries.op10_shard_tree(spark, SMALL).collect():
        assert (r["shard"], r["grown_shard"]) == (brute.shard_of(r["doc_id"], tree), brute.shard_of(r["doc_id"], shard_tree.grown(tree)))
    uneven = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 2.0), (4, 0.5), (5, 1.0)]]]
    got = shard_tree.shard(edge, uneven).collect()
    assert len({r["shard"] for r in got}) > 1 and all(r["shard"] == brute.shard_of(r["doc_id"], uneven) for r in got)


def test_draws_follow_weights(spark):
    """Shares follow weights, and a change moves documents only into or out of
    the subtrees whose weights change."""
    from pyspark.sql import functions as F
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 2.0)]]]
    heavier = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0)]]]
    d = spark.range(20_000).select("id", *[shard_tree.descend(F.col("id"), t).alias(n) for n, t in
                                          (("a", tree), ("b", heavier), ("c", shard_tree.grown(shard_tree.grown(tree))),
                                           ("d", shard_tree.grown(tree)))]).toPandas()
    share = d["a"].value_counts(normalize=True)
    for shard, weight in ((0, 1), (1, 3), (2, 2), (3, 2)):
        assert abs(share[shard] - weight / 8) < 0.015
    moved = d[d["a"] != d["b"]]
    assert len(moved) and set(moved["b"]) == {3}
    assert set(d[d["c"] != d["d"]]["c"]) == {5} and set(d[d["d"] != d["a"]]["d"]) == {4}


def test_shard_files(spark, tmp_path):
    docs = queries.read_corpus(spark, SMALL, "documents")
    shard_tree.write_shards(docs, shard_tree.balanced_tree(4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}

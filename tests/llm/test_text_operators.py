"""Line, SimHash and span de-duplication, quality rules and mixing against
plain Python, on a small table and on edge cases."""

import hashlib
from collections import Counter

import brute
import pytest
from cases import SMALL, edge, edge_rows, empty, small  # noqa: F401 (fixtures)
from pyspark.sql import functions as F

from ordertide.llm import bloom, line_dedup, mixing, quality_llr, queries, simhash, span_dedup
from ordertide.llm.components import connected_components


def test_line_dedup_small(spark, small):
    got = {r["doc_id"]: r for r in queries.op4_dedup_lines(spark, SMALL).collect()}
    for (i, _, _), (text, n, dropped) in zip(small, brute.dedup_lines([r[:2] for r in small])):
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (n, dropped)
        assert got[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("max_bits", [1 << 20, 1 << 30])
def test_line_dedup_edges(edge, max_bits):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = line_dedup.dedup_lines(edge, max_bits=max_bits, carry=("lang", "source")).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute.dedup_lines(rows))]
    assert sorted(map(str, [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got])) == sorted(map(str, want))
    assert any(x[3] for x in want)


def test_filter_misses_nothing(spark):
    """Every hash that occurs twice is suspected, even by a far too small filter."""
    texts = spark.createDataFrame([(f"{i % 900} {i}",) for i in range(2000)], "text string").repartition(5)

    def of(t):
        import numpy as np
        import xxhash
        return np.array([xxhash.xxh64_intdigest(x) for x in (t or b"").split()], dtype=np.uint64)

    seen = bloom.twice_seen(texts, of, 10)
    assert seen.suspects(of(b" ".join(str(i).encode() for i in range(900)))).all()
    assert not seen.suspects(of(b" ".join(str(i).encode() for i in range(3000, 4000)))).any()


def test_simhash_small(spark, small):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, SMALL).collect()}
    rows = [r[:2] for r in small]
    assert got == {i: x for (i, _), x in zip(rows, brute.simhash_groups(rows))}


def test_simhash_edges(edge):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(edge).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute.simhash_groups(rows))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = simhash.keep_one(edge)
    assert kept.dtypes == edge.dtypes
    assert kept.count() == len(set(brute.simhash_roots(rows)[1]))


@pytest.mark.parametrize("groups", [3, 4, 6, 9])
def test_pivot_links_are_all_links(spark, groups):
    """Every pair within two bits is found whatever the number of groups, in a
    dense ball of fingerprints and among scattered ones."""
    import random
    rng = random.Random(groups)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    prints |= {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, (1 << 64) - 2}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.pivot_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, groups).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in links} == want and len(links) == len(want)


def test_groups_grow_with_the_classes():
    assert simhash.block_groups(1000, 2) == 4
    assert simhash.block_groups(10 ** 12, 2) > simhash.block_groups(10 ** 10, 2) >= 4


def test_components(spark):
    """Paths, stars, loops and repeated edges."""
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 140)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spans_small(spark, small):
    got = {r["doc_id"]: r["text"] for r in queries.op6_span_dedup(spark, SMALL).collect()}
    rows = [r[:2] for r in small]
    cut = lambda t: [u.decode() for u in span_dedup.units(t.encode())]
    assert got == {i: x for (i, _), x in zip(rows, brute.dedup_spans(rows, cut, 2, 30))}


def test_first_occurrence_stays_whole(spark):
    """Runs that overlap themselves keep their first span, and copies lose all."""
    rows = [(1, "Der " * 128), (2, "Der " * 128), (3, "one two, " * 40 + "and the end of it."), (4, "x " + "one two, " * 40),
            (5, "it repeats itself, and nobody else, " * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(d).collect()}
    cut = lambda t: [u.decode() for u in span_dedup.units(t.encode())]
    assert list(got[i] for i, _ in rows) == brute.dedup_spans(rows, cut, 2, 30) and got[5] == rows[4][1]
    alone = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(d, across=False).collect()}
    assert list(alone[i] for i, _ in rows) == brute.dedup_spans(rows, cut, 2, 30, across=False) and len(alone[5]) < 300
    assert 30 <= len(got[1].split()) < 60 and got[2] == "" and got[3].startswith("one two, " * 15) and len(got[3].split()) < 60


def test_key_filter(spark):
    from ordertide.llm.bloom import key_filter
    keys = [(k * 0x9E3779B97F4A7C15 + 1 << 63) % (1 << 64) - (1 << 63) for k in range(5000)]
    held = key_filter(spark.createDataFrame([(k,) for k in keys], "key long"), len(keys))
    import numpy as np
    assert held.holds(np.array(keys, dtype=np.int64).view(np.uint64)).all()
    others = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert held.holds(others).mean() < 0.05
    assert not key_filter(spark.createDataFrame([], "key long"), 0).holds(others).any()


def test_passage_in_mid_sentence(spark):
    """A passage of over 50 words pasted anywhere goes from all but its first document."""
    passage = ("the river ran past the old mill, and under the bridge of stone. Nobody had crossed it for years; the "
               "planks were gone. In spring the water rose up to the road, so people went round by the hill, which took "
               "them an hour more. They did not mind, as the view from there was good.")
    rows = [(i, f"Document number {i} says x{i} y{i} z{i}, {passage} and so ends text {i}.") for i in range(1, 6)]
    rows.append((9, "A clean document that shares nothing with others, and stays as it is, in whole. Every word."))
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[9] == rows[-1][1]
    for i in range(2, 6):
        assert "under the bridge" not in got[i] and "took them an hour" not in got[i] and f"x{i} y{i}" in got[i]


def _without_repeated_runs(rows, sentences, min_words):
    """Kept text of each row: every run of enough units and words is looked for."""
    cut = {i: [u.decode() for u in span_dedup.units(t.encode())] for i, t in rows}
    places = {}
    for i, parts in cut.items():
        w = [brute.words(u.translate(brute.ASCII_LOWER)) for u in parts]
        at = [k for k, x in enumerate(w) if x]
        for a in range(len(at)):
            for b in range(a + sentences, len(at) + 1):
                if sum(len(w[k]) for k in at[a:b]) >= min_words:
                    places.setdefault(tuple(" ".join(w[k]) for k in at[a:b]), []).append((i, at[a], at[b - 1] + 1))
    gone = {(i, k) for p in places.values() for i, a, b in p if (i, a, b) != min(p) for k in range(a, b)}
    return {i: "".join(u for k, u in enumerate(parts) if (i, k) not in gone) for i, parts in cut.items()}


def test_spans_are_all_runs(spark):
    """Tails that no run from an earlier cut reaches go, too: copies lose every word, passages their last sentences."""
    import random
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(rng.randint(1, 9))) + rng.choice(".,;!") + " "
    whole = "".join(sentence() for _ in range(12))
    passage = "".join(sentence() for _ in range(6))
    rows = [(1, whole), (2, whole), (3, "".join(sentence() for _ in range(4)) + passage + "Then it goes on. "),
            (4, "".join(sentence() for _ in range(3)) + passage + "And on, but otherwise. "), (5, passage)]
    rows += [(6 + k, "".join(sentence() for _ in range(2)) + whole[:k * 30]) for k in range(4)]
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), sentences=2, min_words=15).collect()}
    assert got == _without_repeated_runs(rows, 2, 15)
    assert got[1] == whole and got[2] == "" and got[5] == "" and passage.split()[-1] not in got[4].split()


def test_spans_without_marks(spark):
    """Text without ASCII marks: runs of one short word, other short words, scripts without spaces, endless words."""
    import random
    rng = random.Random(6)
    short = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60))
    zh = "春天来了，河水涨到了路边。人们绕过山坡走，多花一个小时！他们不介意，因为那里的风景很好？"
    plain = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(150))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(150))
    token = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400_000))
    parts = ["Der " * 128, short, zh, plain, thai, token]
    rows = [(10 * k + i, t) for k, t in enumerate(parts) for i in (1, 2)]
    rows += [(100, f"这是另一篇文章的开头。{zh}文章在这里结束。"), (101, f"nobody knows who wrote any of it {short} nor what it may be good for"),
             (102, f"这是又一篇文章的开头{plain}文章在这里结束")]
    assert all(b"".join(span_dedup.units(t.encode())) == t.encode() for _, t in rows)
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), sentences=2, min_words=15).collect()}
    assert all(not got[10 * k + 2] for k in range(len(parts)))
    assert all(got[10 * k + 1] == t for k, t in enumerate(parts) if k)
    assert got[100] == "这是另一篇文章的开头。文章在这里结束。"
    assert len(set(short.split()) & set(got[101].split())) < 15 and got[101].startswith("nobody knows") and "good for" in got[101]
    assert len(set(plain) & set(got[102])) < 50 and got[102].startswith("这是又一篇文章") and got[102].endswith("结束")


def test_spans_edges(edge, empty):
    got = span_dedup.dedup_spans(edge, carry=("source",), across=False).collect()
    assert len(got) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (6, 7)}
    assert "n_removed" in got[0] and by_id[2]["text"] is None and by_id[3]["text"] == "" and by_id[4]["text"] == " \n\t \n"
    assert len(by_id[5]["text"]) < 300 and by_id[5]["n_removed"] > 7000  # the long text repeats itself


def test_rules_small(spark, small):
    got = {r["doc_id"]: r for r in queries.op5_quality_llr(spark, SMALL).collect()}
    for i, t, _ in small:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(t)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.15)


def test_rules_edges(edge):
    trusted = edge.sparkSession.createDataFrame([(9,), (1,)], "doc_id long")
    got = quality_llr.judge(edge, trusted, buckets=256).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(str((r["doc_id"], *(r[c] for c in cols))) for r in got) == sorted(str((r[0], *brute.rules(r[1]))) for r in edge_rows())
    assert all(r["score"] == 0 for r in got if r["n_words"] == 0)


def test_ratio_by_hand(spark):
    """Scores are mean log ratios of hashed unigrams and bigrams, with 16 n-grams at the mean ratio added to each bucket."""
    import math
    docs = [(1, "good words here and good words there"), (2, "good words here too"), (3, "## bad ## bad ## bad"), (4, "good bad")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_llr.judge(d, spark.createDataFrame([(1,), (2,)], "doc_id long"), buckets=64).collect()}
    rows = {r["doc_id"]: r["grams"] for r in quality_llr.with_grams(d, 64).collect()}
    assert {i: len(g) for i, g in rows.items()} == {1: 13, 2: 7, 3: 11, 4: 3}
    every, t = Counter(g for x in rows.values() for g in x), Counter(g for i in (1, 2) for g in rows[i])
    share = sum(t.values()) / sum(every.values())
    for i, grams in rows.items():
        want = sum(math.log((t[g] + 16 * share) / (every[g] + 16) / share) for g in grams) / len(grams)
        assert abs(got[i] - want) < 1e-4
    assert got[1] > 0 > got[3]


def test_every_trusted_document_counts(spark, tmp_path):
    """Where all documents are trusted, all ratios are 0, whatever their number; so they are by a shuffle join."""
    from pyspark.sql import functions as F
    n = 20_400
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(12)],
                                                                           F.concat(F.lit("x"), F.col("id") % 9)).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    scores = queries.op5_quality_llr(spark, str(tmp_path)).select("score").distinct().collect()
    assert [r["score"] for r in scores] == [0.0]
    some = docs.where("doc_id % 3 = 0").select("doc_id")
    assert quality_llr.log_ratios(docs, some, 64, max_bytes=0) == quality_llr.log_ratios(docs, some, 64)


def test_quality_agrees_with_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in queries.read_corpus(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = {r["doc_id"]: r for r in queries.op5_quality_llr(spark, "/root/testdata/sf0.01").collect()}
    right = sum(got[i]["kept"] == bool(q) for i, q in labels.items())
    assert right >= 0.97 * len(labels)


def test_quality_of_documents_never_trusted(spark):
    """Labels of documents that gave no target counts are met, and twice the buckets change next to no verdict."""
    from pyspark.sql import functions as F
    docs, labels = (queries.read_corpus(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    trusted = quality_llr.trusted(labels.where(~held))
    got, twice = ({r["doc_id"]: r["kept"] for r in quality_llr.judge(docs, trusted, **o).collect()} for o in ({}, {"buckets": 1 << 19}))
    want = {r["doc_id"]: r["quality"] == 1 for r in labels.where(held & F.col("quality").isNotNull()).collect()}
    assert sum(got[i] == q for i, q in want.items()) >= 0.97 * len(want)
    assert sum(got[i] != twice[i] for i in got) <= 0.005 * len(got)


def test_very_long_text_is_judged(spark):
    """A text of 400,000 words is read whole."""
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400_000))), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_llr.judge(d, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["kept"]) == (400_000, 0, True) and not got[2]["kept"]


def test_mix_small(spark, small):
    got = {r["doc_id"]: r for r in queries.op1_mix_sources(spark, SMALL).collect()}
    want = brute.mix(small)
    assert got.keys() == want.keys()
    for i, (size, total, target, copies) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size, total, copies * size)
        assert abs(r["target"] - target) < 1e-6 and r["taken"] <= 2 * size


def test_mix_edges(edge):
    got = mixing.mix(edge)
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    again = mixing.mix(edge).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert own[0]["target"] <= 2 * own[0]["source_size"] and all(r["copies"] <= 2 for r in own)
    total = sum(r["size"] for r in rows)
    assert abs(sum(own[0]["target"] for own in by_source.values()) - 1.5 * total) < 1e-6
    taken = mixing.take(edge.select("doc_id", "text", "source"), got)
    assert taken.columns == ["doc_id", "text", "source"]
    words_of = lambda rows: Counter({s: sum(len(brute.words(r["text"])) for r in rows if r["source"] == s)
                                     for s in {r["source"] for r in rows}})
    assert words_of(taken.collect()) == Counter({s: sum(r["taken"] for r in own) for s, own in by_source.items()})


def test_take_rows_that_repeat(spark):
    """Rows that share an id, have none, or are equal are taken as often as the
    mixture drew them, whatever their other columns say."""
    rows = [(i % 9 if i % 4 else None, f"text {i % 13} " * (1 + i % 5), "ab"[i % 2], f"lang{i % 3}") for i in range(120)]
    rows += [(7, "the same row again and again", "a", "en")] * 31
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    for budget in (0.3, 1.1, 1.5):
        mixed = mixing.mix(d, source_weights=(1, 1), budget=budget)
        want = Counter()
        for r in mixed.collect():
            want[r["doc_id"], r["source"], r["row_hash"]] += r["copies"]
        taken = mixing.take(d, mixed)
        assert taken.columns == d.columns
        got = Counter((r["doc_id"], r["source"], r["h"]) for r in taken.withColumn(
            "h", mixing.row_hash("doc_id", "text", "source")).collect())
        assert got == +want
        most = Counter(rows)
        full = Counter(map(tuple, taken.collect()))
        assert all(n <= 2 * most[r] for r, n in full.items())
        assert full == Counter(map(tuple, mixing.take(d.repartition(3), mixed).collect()))


def test_line_dedup_counts_documents(spark):
    """Four equal rows of a document and one other document are two documents."""
    line = "a line of more than forty code points that repeats in the table"
    rows = [(1, line)] * 4 + [(2, line)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(d, min_docs=5).collect()} == {0}
    for more in ([(3, line), (4, line), (5, "x\n" + line)], [(None, line), (None, line), (3, line), (4, line)]):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows + more, d.schema), min_docs=5).collect()
        last = max(i for i, _ in rows + more if i is not None)
        assert all((r["n_dropped"] == 0) == (r["doc_id"] == last) for r in got)


def test_quality_weighs_the_draw(spark):
    """Heavier documents are taken more often."""
    rows = [(i, "a b c d e f g h i j", "s", 1.0 if i % 2 else 0.1) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(d, weight=F.col("q"), budget=0.25).where("copies = 1").groupBy((F.col("doc_id") % 2).alias("k")).count().collect()
    n = {r["k"]: r["count"] for r in got}
    assert abs(n[0] + n[1] - 500) <= 1 and n[1] > 4 * n[0]


def test_empty_tables(empty):
    spark = empty.sparkSession
    ids = spark.createDataFrame([], "doc_id long")
    for out in (mixing.mix(empty), simhash.near_duplicates(empty), simhash.keep_one(empty), line_dedup.dedup_lines(empty),
                span_dedup.dedup_spans(empty), quality_llr.judge(empty, ids, buckets=16)):
        assert out.count() == 0

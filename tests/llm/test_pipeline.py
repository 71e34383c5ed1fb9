"""The corpus pipeline, stage by stage, against plain Python."""

import brute
import corpus_pipeline as C
import pytest
from cases import SMALL, edge  # noqa: F401 (fixtures)
from pyspark.sql import functions as F

from ordertide.llm import pu_classifier
from ordertide.llm.tables import read_corpus, stored


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_corpus(spark, SMALL, "documents"), []
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test-pipeline")
        out.append(docs)
    return out


def test_order():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing to target weights",
                                        "best-fit packing"]


def test_stages(spark, stages):
    docs, labels = read_corpus(spark, SMALL, "documents"), read_corpus(spark, SMALL, "labels")
    assert all(s.columns == docs.columns for s in stages[:-1])
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    accepted = {r["doc_id"] for r in pu_classifier.classify(docs, labels).where("score >= 0.5").collect()}
    assert sorted(rows(stages[0], *docs.columns)) == sorted(r for r in rows(docs, *docs.columns) if r[0] in accepted)
    first = sorted(rows(stages[0], "doc_id", "text"))
    want = [(i, t) for (i, _), (t, _, _) in zip(first, brute.dedup_lines(first))]
    assert sorted(rows(stages[1], "doc_id", "text")) == want
    assert stages[1].where(F.length("text") != F.col("n_chars")).count() == 0
    kept = [(i, t) for (i, t), (_, c) in zip(want, brute.simhash_groups(want)) if c == i]
    assert sorted(rows(stages[2], "doc_id", "text")) == kept
    mixed = brute.mix(rows(stages[2], "doc_id", "text", "source"))
    taken = rows(stages[3], "doc_id")
    assert sorted(taken) == sorted((i,) for i, x in mixed.items() for _ in range(x[3]))


def test_sequences(stages):
    from test_vectors_pages_packs import _check_packed, _tokenizer
    t = _tokenizer()
    texts = [(r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in stages[3].collect()]
    rows = stages[4].collect()
    assert sorted((i, (n - 1) // 4096) for i, n in texts) == sorted(
        (r["doc_id"], r["piece"]) for r in rows if r["length"] + r["start"] == dict(texts)[r["doc_id"]])
    n = _check_packed(rows, 4096)
    assert sum(r["length"] for r in rows) == sum(n for _, n in texts)
    assert n <= sum(n for _, n in texts) / 4096 * 1.02 + 1


def test_run(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, C.run(spark, SMALL).select(*cols).collect())) == sorted(map(tuple, stages[4].select(*cols).collect()))


def test_stages_on_edges(spark, edge, tmp_path):
    """Nulls, blanks, repeated rows and clashing names go through every stage."""
    for t in ("labels",):
        read_corpus(spark, SMALL, t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = edge
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "test-edges")
    assert docs.count() > 0
    empty = edge.where("false")
    for _, stage in C.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0

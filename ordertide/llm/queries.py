"""The registered queries of the subpackage: thin applications of its operators
to whole tables with production parameters, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.llm import (embed_forest, html_tree, lattice_lm, line_dedup, mixing, packing, pu_classifier, quality_llr, shard_tree,
                            simhash, sketch_search, span_dedup, whiten)
from ordertide.llm.tables import read_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24


def register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return deco


@register("""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE *
      ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE
       / greatest(length(coalesce(text, '')), 1))) AS wt,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42'), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
        WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM c),
k AS (SELECT *, cap <= level * w AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, w * (
        (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
        / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())) END AS target FROM k),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / wt, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((epochs + CASE WHEN before < target - epochs * source_size
     AND before + size - (target - epochs * source_size) <= (target - epochs * source_size) - before
     THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents: sources weigh 5, 2, 1 and share 150 % of
    all words, each at most twice over."""
    out = mixing.mix(read_corpus(spark, sf_dir, "documents"), source_weights=(5, 2, 1), budget=1.5, max_epochs=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@register("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''),
        '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.keeper AS dropped FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op4_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents: lines of at least 40 code points found in
    at least 5 documents stay only in the largest doc_id."""
    out = line_dedup.dedup_lines(read_corpus(spark, sf_dir, "documents"), min_chars=40, min_docs=5, keep="last")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@register()
def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents: 24 shards in 3 regions of 2 racks, law
    ``key``: the doc_id and the tree decide."""
    out = shard_tree.shard(read_corpus(spark, sf_dir, "documents"), shard_tree.balanced_tree(SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"),
                      "grown_shard")


@register()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents: 3-word shingles, links at 2 or fewer
    differing bits."""
    out = simhash.near_duplicates(read_corpus(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    """The public word tokenizer's file, where its package is installed."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register()
def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents: sequences of at most 4096 tokens."""
    pieces = packing.tokenize(read_corpus(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, capacity=4096)


@register()
def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: the target counts come from all
    documents that ``labels`` marks quality 1, the corpus counts from all
    documents."""
    trusted = quality_llr.trusted(read_corpus(spark, sf_dir, "labels"))
    out = quality_llr.judge(read_corpus(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "score")


@register()
def op8_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all pages."""
    return html_tree.extract(read_corpus(spark, sf_dir, "pages"))


@register()
def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents: spans of 2 or more sentences or clauses
    and at least 30 words stay only where they occur first."""
    out = span_dedup.dedup_spans(read_corpus(spark, sf_dir, "documents"), sentences=2, min_words=30)
    return out.select("doc_id", "text", "n_removed",
                      F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@register()
def op7_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents: trained on at most 6,000 trusted and
    6,000 unlabelled documents, none of them held out."""
    return pu_classifier.classify(read_corpus(spark, sf_dir, "documents"), read_corpus(spark, sf_dir, "labels"))


@register("""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op3_embed_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all embeddings: links at a cosine of 0.93 or more within
    a label."""
    out = embed_forest.link(read_corpus(spark, sf_dir, "embeddings"), threshold=0.93)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@register("""
WITH p AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM p),
a AS (SELECT sum(len(terms))::HUGEINT AS l, count(*) FILTER (WHERE len(terms) > 0)::HUGEINT AS n FROM d),
i AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark),
qt AS (SELECT DISTINCT q, item_id, unnest(terms) AS term FROM i),
tf AS (SELECT r, term, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
df AS (SELECT term, floor(1000 * ln((2 * any_value(a.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM tf, a GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(terms) * a.n) // a.l) AS m FROM d, a WHERE len(terms) > 0),
s AS (SELECT qt.q, qt.item_id, m.doc_id, m.r, sum(df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS score
      FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM k WHERE rank <= 10""")
def op11_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: all documents ranked for each benchmark item."""
    return sketch_search.search(read_corpus(spark, sf_dir, "documents"), read_corpus(spark, sf_dir, "benchmark"), k=10)


def vocabulary_path() -> str:
    """The public subword vocabulary's file, where its package is installed."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register()
def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all documents, learning from nine tenths of them."""
    vocabulary = lattice_lm.read_vocabulary(vocabulary_path(), ranked=True)
    return lattice_lm.score(read_corpus(spark, sf_dir, "documents"), vocabulary, rounds=3)


@register()
def op13_whiten_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all embeddings: 8 components; a deviation beyond 64
    bits is null."""
    out = whiten.whiten(read_corpus(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))

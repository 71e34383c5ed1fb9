"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled documents (bounded samples, by hash of the
id) train a logistic score by the non-negative unbiased risk of Kiryo et al.
2017: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). The class prior is
estimated first (Scott 2015): among the sets that a positive-versus-unlabelled
score cuts off, the least ratio of unlabelled to positive shares bounds it.
No negative label is used.

A document's features come from its whole text alone: shares of kinds of
characters, repetition, and hashed one- and two-word shapes (a run of lower
case letters counts as one "a", digits as "0", other signs as they are), so
they hold for any language of the script.

Scale: sampling orders ids by hash (a top-k, no full sort); features of the
sample, bounded rows of fixed width, train the model on the driver; scoring is
one pass without shuffle, with a model of a few kilobytes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.bloom import binary_column
from ordertide.llm.tables import pick

BUCKETS = 512
STATS = 16
SIZE = STATS + BUCKETS
_KINDS = bytes.maketrans(bytes(range(256)), bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)))
_RUNS = re.compile(rb"a{2,}|A{2,}|0{2,}")


def features(text: bytes | None) -> np.ndarray:
    """The text's features; all zero for texts without a word."""
    out = np.zeros(SIZE, dtype=np.float32)
    w = (text or b"").split()
    if not w:
        return out
    n, size = len(w), len(text)
    kinds = text.translate(_KINDS)
    count = Counter(w)
    pairs = Counter(zip(w, w[1:]))
    letters, upper = kinds.count(b"a"), kinds.count(b"A")
    lines = text.split(b"\n")
    out[:STATS] = (
        np.log1p(n), np.log1p(size) - np.log1p(n), letters / size, upper / max(1, letters + upper), kinds.count(b"0") / size,
        sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / size,
        text.count(b"!") / size, text.count(b",") / n, text.count(b".") / n, len(count) / n ** 0.9,
        max(count.values()) / n, 1 - len(pairs) / max(1, n - 1), sum(a == b for a, b in zip(w, w[1:])) / n,
        1 - len(set(lines)) / len(lines), len(lines) / n, sum(x * x for x in count.values()) / (n * n))
    shapes = _RUNS.sub(lambda m: m.group()[:1], kinds).split()
    for grams, share in ((Counter(shapes), 1 / n), (Counter(zip(shapes, shapes[1:])), 1 / n)):
        for g, c in grams.items():
            key = g if isinstance(g, bytes) else b" ".join(g)
            out[STATS + zlib.crc32(key) % BUCKETS] += c * share
    out[STATS:] = np.sqrt(out[STATS:])
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def positive_or_unlabelled(p: np.ndarray, u: np.ndarray, l2: float, steps: int, rate: float) -> np.ndarray:
    """Weights of a balanced logistic regression of positives against unlabelled rows."""
    def gradient(w):
        w32 = w.astype(np.float32)
        return -(_sigmoid(-(p @ w32)) @ p) / len(p) / 2 + (_sigmoid(u @ w32) @ u) / len(u) / 2 + l2 * w
    return _adam(gradient, p.shape[1], steps, rate)


def class_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """The least ratio of the unlabelled to the positive share above a cut,
    over cuts that keep at least half the positives; from 0.01 to 0.99."""
    cuts = np.quantile(p_scores, np.linspace(0.005, 0.5, 100))
    return float(np.clip(min((u_scores >= c).mean() / (p_scores >= c).mean() for c in cuts), 0.01, 0.99))


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, l2: float, steps: int, rate: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with logistic loss."""
    def gradient(w):
        w32 = w.astype(np.float32)
        zp, zu = p @ w32, u @ w32
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = (_sigmoid(zu) @ u) / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
        if negative < 0:  # the estimated risk of negatives can't be negative: undo what made it so
            return -g_negative + l2 * w
        return -prior * (_sigmoid(-zp) @ p) / len(p) + g_negative + l2 * w
    return _adam(gradient, p.shape[1], steps, rate)


class Model:
    """Standardisation and weights."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, squares of the statistics, one (float32)."""
        out = np.ones((len(x), SIZE + STATS + 1), dtype=np.float32)
        z = out[:, :SIZE]
        np.clip((x - self.mean) / self.scale, -8, 8, out=z)
        np.square(z[:, :STATS], out=out[:, SIZE:SIZE + STATS])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.design(x).astype(np.float64) @ self.weights)


def train(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, l2: float = 1e-3,
          steps: int = 300, rate: float = 0.05) -> Model:
    """A model from rows of features. Without positives or unlabelled rows it
    scores 0.5 everywhere."""
    n = SIZE + STATS + 1
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), np.zeros(n), 0.5)
    both = np.concatenate([positives, unlabelled])
    mean, scale = (f(both, axis=0, dtype=np.float64).astype(np.float32) for f in (np.mean, np.std))
    model = Model(mean, scale + np.float32(1e-3), np.zeros(n), 0.5)
    del both
    p, u = model.design(positives), model.design(unlabelled)
    if prior is None:
        # fit on one half, estimate on the other
        w = positive_or_unlabelled(p[::2], u[::2], l2, steps, rate)
        hp, hu = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
        prior = class_prior(hp @ w, hu @ w)
    model.prior = prior
    model.weights = non_negative_risk(p, u, prior, l2, steps, rate)
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        same = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "trusted")]
        x = [features(t).tobytes() for t in binary_column(b, "text")]
        yield pa.RecordBatch.from_arrays([*same, pa.array(x, pa.binary())], ["doc_id", "trusted", "x"])


def _scores(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = np.stack([features(t) for t in binary_column(b, "text")])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(b.schema.get_field_index(c)) for c in columns], pa.array(model.score(x))],
                    [*columns, "score"])
    return run


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(0)) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = 6000, unlabelled_rows: int = 6000,
        prior: float | None = None) -> Model:
    """Train on at most ``positive_rows`` documents that ``labels`` (doc_id,
    quality) marks 1 and ``unlabelled_rows`` of all documents, held-out rows
    excluded from both. ``docs``: doc_id, text. Of rows that share an id one
    is taken; null ids and labels take no part."""
    def sample(ids: DataFrame, n: int, trusted: int) -> DataFrame:
        ids = ids.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
        return ids.orderBy(F.xxhash64("doc_id", F.lit(trusted)), "doc_id").limit(n).withColumn("trusted", F.lit(trusted))

    chosen = sample(labels.where("quality = 1"), positive_rows, 1).unionByName(sample(docs, unlabelled_rows, 0))
    chosen = chosen.select(F.col("doc_id").alias("__id"), "trusted")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "trusted", "text")
    id_type = dict(docs.dtypes)["doc_id"]
    x = rows.mapInArrow(_sample_features, f"doc_id {id_type}, trusted int, x binary")
    got = x.groupBy("doc_id", "trusted").agg(F.min("x").alias("x")).collect()  # positive_rows + unlabelled_rows at most
    got.sort(key=lambda r: (r["trusted"], r["doc_id"]))
    parts = [np.frombuffer(b"".join(r["x"] for r in got if r["trusted"] == k), np.float32).reshape(-1, SIZE) for k in (1, 0)]
    del got
    return train(*parts, prior=prior)


def classify(docs: DataFrame, labels: DataFrame, positive_rows: int = 6000, unlabelled_rows: int = 6000,
             prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher:
    likelier good), predicted (1 if score >= 0.5, else 0), and the ``carry``
    columns ("text" for the text; names must differ from the result's own).

    Null, empty and blank texts get the score of a text without features. With
    no usable label every score is 0.5. Equal texts get equal scores whatever
    their ids; repeated rows and null ids are scored like others; empty tables
    give empty results. Other columns are not read."""
    d = pick(docs, doc_id=id_col, text=text_col)
    model = fit(d, labels, positive_rows, unlabelled_rows, prior)
    more = [c for c in carry if c != "text"]
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                    *[F.col(f"`{c}`") for c in more])
    columns = ["doc_id", *carry]
    schema = ", ".join([f"`{c}` {t}" for c, t in d.select(*[F.col(f"`{c}`") for c in columns]).dtypes] + ["score double"])
    out = d.mapInArrow(_scores(model, columns), schema)
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *[F.col(f"`{c}`") for c in carry])

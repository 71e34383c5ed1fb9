"""Language-model scores from a subword lattice.

A word's lattice has an arc for every piece of an existing subword vocabulary
that matches somewhere in it; code points that are no piece go by the
vocabulary's byte pieces. The pieces' scores weight all segmentations, and the
forward recursion in log space sums them: a word's marginal probability, not
that of its best segmentation. A first piece carries the vocabulary's word
mark, further ones do not, and an end closes the word, so the probabilities of
all words add to at most 1.

What is learned, from all training texts: the counts of their words, each of
which is an arc over the whole word; and the pieces' scores, which start at
the vocabulary's own and are re-estimated as expected counts over all
segmentations (forward and backward) of all distinct training words. A token w
of c occurrences among N gets

    (c - d) / N + (d V / N) * lattice(w)

(absolute discounting; d from the numbers of words seen once and twice, V
distinct tokens), so seen words share what is left to unseen ones, and all
probabilities add up to 1. The text's end is a token like others. The
document's score is the sum over its tokens.

Scale: words are counted with map-side aggregation, and the lattice runs once
for each distinct word. Tasks hold the most frequent words (a documented
bound); the rest of a document's words meets the word table in a join whose
large side Spark can split. The pieces' tables are as large as the
vocabulary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.bloom import binary_column
from ordertide.llm.tables import pick, stored

MARK = "▁"
#: The base model of the contract adds so much to each count.
BASE_ADD = 0.1
#: Distinct words of a task's partial counts before they leave it, and words of one lattice block.
FLUSH_WORDS, LATTICE_WORDS = 1 << 18, 1 << 14
#: Expected counts travel as whole numbers of this unit, so their sums don't depend on the order of tasks.
MASS_UNIT = 1 << 20
#: Weight of the vocabulary's own scores, in pieces, when they are re-estimated.
PRIOR = 1000.0
LONGEST_IN_BLOCKS = 256


class Vocabulary:
    """Pieces of an existing vocabulary: slot 0 ends a word; every other slot
    is a piece at a word's start (with the mark) or within it."""

    def __init__(self, pieces: list[tuple[str, float]], byte_scores: list[float], start_end: float):
        starts = [(p[1:], s) for p, s in pieces if p.startswith(MARK) and MARK not in p[1:]]
        inner = [(p, s) for p, s in pieces if p and MARK not in p]
        self.starts = {p: i + 1 for i, (p, _) in enumerate(starts)}  # "" is the mark alone
        at = len(starts) + 1
        self.inner = {p: at + i for i, (p, _) in enumerate(inner)}
        self.bytes = at + len(inner)  # the slots of the 256 bytes
        self.size = self.bytes + 256
        self.longest = max(map(len, [*self.starts, *self.inner]), default=1)
        self.starts.setdefault("", self.size)
        if self.starts[""] == self.size:
            self.size += 1
            starts = [*starts, ("", min(byte_scores))]
        self.scores = np.zeros(self.size)
        self.scores[0] = start_end
        for p, s in starts:
            self.scores[self.starts[p]] = s
        for p, s in inner:
            self.scores[self.inner[p]] = s
        self.scores[self.bytes:self.bytes + 256] = byte_scores
        self.at_start = np.zeros(self.size, dtype=bool)
        self.at_start[list(self.starts.values())] = True

    def logs(self, mass: np.ndarray) -> np.ndarray:
        """Natural logs of the masses as two distributions: of the pieces at a
        word's start, and of the others and the end."""
        out = np.empty(self.size)
        for part in (self.at_start, ~self.at_start):
            out[part] = np.log(mass[part]) - math.log(mass[part].sum())
        return out

    def first_mass(self) -> np.ndarray:
        """The vocabulary's own scores as masses, PRIOR for each distribution."""
        out = np.exp(self.scores)
        for part in (self.at_start, ~self.at_start):
            out[part] *= PRIOR / out[part].sum()
        return out


def read_vocabulary(path: str, ranked: bool = True) -> Vocabulary:
    """The vocabulary of a sentencepiece model file. ``ranked``: the file's
    scores are negated ranks (as in vocabularies of merges), and a piece's
    weight is one over its rank; else they are natural logs."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score = lambda i: -math.log(1.0 + max(0.0, -sp.get_score(i))) if ranked else sp.get_score(i)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    lowest = min((score(i) for i in usual), default=-1.0)
    byte = [lowest] * 256
    return Vocabulary([(sp.id_to_piece(i), score(i)) for i in usual], byte, max(map(score, usual), default=-1.0))


class Lattice:
    """The lattices of words under given log masses of the pieces."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray):
        self.v, self.logs = vocabulary, logs
        self._keys: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {}
        for start, table in ((True, vocabulary.starts), (False, vocabulary.inner)):
            by_length = []
            for length in range(1, vocabulary.longest + 1):
                some = sorted((self._key(p), slot) for p, slot in table.items() if len(p) == length)
                by_length.append((np.array([k for k, _ in some], dtype=np.uint64), np.array([s for _, s in some], dtype=np.int64)))
            self._keys[start] = by_length

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def _key(self, piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(self.MULTIPLIER) + ord(c) + 1) % (1 << 64)
        return out

    def _slots(self, points: np.ndarray, length: int, start: bool) -> np.ndarray:
        """The slot, or -1, of every run of ``length`` code points (words,
        places); the keys of a 64-bit hash are distinct within a vocabulary."""
        keys, slots = self._keys[start][length - 1]
        n = points.shape[1] - length + 1
        h = np.zeros((points.shape[0], n if not start else 1), dtype=np.uint64)
        for k in range(length):
            h = h * self.MULTIPLIER + points[:, k:k + h.shape[1]] + np.uint64(1)
        if not len(keys):
            return np.full(h.shape, -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, slots[at], -1)

    def _byte_slots(self, point: int) -> list[int]:
        return [self.v.bytes + b for b in chr(point).encode("utf-8", "surrogatepass")]

    def arcs(self, points: np.ndarray) -> tuple[list, np.ndarray, dict[int, list[int]]]:
        """For words of equal length: per arc length from 1 the inner slots
        and the start slots; the code points that go by bytes."""
        length = points.shape[1]
        longest = min(self.v.longest, length)
        inner = [self._slots(points, k, False) for k in range(1, longest + 1)]
        start = [self._slots(points, k, True)[:, 0] for k in range(1, longest + 1)]
        strange = {int(p): self._byte_slots(int(p)) for p in np.unique(points[inner[0] < 0])}
        return inner, start, strange

    def forward(self, points: np.ndarray, arcs: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """alpha (word, place): the log mass of all ways to a place, and the
        arcs; the word's marginal is alpha at its end times the end's mass."""
        inner, start, strange = arcs = arcs or self.arcs(points)
        words, length = points.shape
        alpha = np.full((words, length + 1), -np.inf)
        alpha[:, 0] = self.logs[self.v.starts[""]]
        weight = [self._weights(inner[0], points, strange), *(self._weights(s) for s in inner[1:])]
        first = [self._weights(s) for s in start]
        for j in range(1, length + 1):
            ways = [alpha[:, j - k] + weight[k - 1][:, j - k] for k in range(1, min(j, len(inner)) + 1)]
            if j <= len(first):
                ways.append(first[j - 1])
            top = np.max(ways, axis=0)
            alpha[:, j] = top + np.log(np.sum(np.exp(np.array(ways) - top), axis=0))
        return alpha, (arcs, weight, first)

    def _weights(self, slots: np.ndarray, points: np.ndarray | None = None, strange: dict | None = None) -> np.ndarray:
        out = np.where(slots >= 0, self.logs[np.maximum(slots, 0)], -np.inf)
        for p, bytes_ in (strange or {}).items():
            out[(slots < 0) & (points == p)] = self.logs[bytes_].sum()
        return out

    def expected(self, points: np.ndarray, mass: np.ndarray) -> None:
        """Add the expected uses of every slot in these words to ``mass``."""
        alpha, ((inner, start, strange), weight, first) = self.forward(points)
        words, length = points.shape
        beta = np.full((words, length + 1), -np.inf)
        beta[:, length] = self.logs[0]
        for i in range(length - 1, -1, -1):
            ways = [weight[k - 1][:, i] + beta[:, i + k] for k in range(1, min(length - i, len(inner)) + 1)]
            top = np.max(ways, axis=0)
            beta[:, i] = top + np.log(np.sum(np.exp(np.array(ways) - top), axis=0))
        total = alpha[:, length] + self.logs[0]
        for k, (slots, w) in enumerate(zip(inner, weight), 1):
            share = np.exp(alpha[:, :length - k + 1] + w + beta[:, k:] - total[:, None])
            np.add.at(mass, slots[slots >= 0], share[slots >= 0])
            if k == 1:
                for p, bytes_ in strange.items():
                    np.add.at(mass, bytes_, share[(slots < 0) & (points == p)].sum())
        for k, (slots, w) in enumerate(zip(start, first), 1):
            share = np.exp(w + beta[:, k] - total)
            np.add.at(mass, slots[slots >= 0], share[slots >= 0])
        mass[self.v.starts[""]] += np.exp(alpha[:, 0] + beta[:, 0] - total).sum()
        mass[0] += words

    def long_marginal(self, word: str) -> float:
        """The natural log of one word's marginal, place by place: for words
        of any length, in memory of its longest piece."""
        v, logs, n = self.v, self.logs, len(word)
        ways = [logs[v.starts[""]]]  # of the last ``longest`` places
        for j in range(1, n + 1):
            found = []
            for k in range(1, min(j, v.longest) + 1):
                piece = word[j - k:j]
                slot = v.inner.get(piece)
                if slot is not None:
                    found.append(ways[-k] + logs[slot])
                elif k == 1:
                    found.append(ways[-1] + logs[self._byte_slots(ord(piece))].sum())
                if k == j and piece in v.starts:
                    found.append(logs[v.starts[piece]])
            top = max(found)
            ways.append(top + math.log(sum(math.exp(x - top) for x in found)))
            if len(ways) > v.longest:
                del ways[0]
        return ways[-1] + logs[0]

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural logs of the words' marginal probabilities."""
        out = np.empty(len(words))
        for at, points in _by_length(words):
            out[at] = (self.forward(points)[0][:, -1] + self.logs[0]) if points is not None else \
                [self.long_marginal(words[i]) for i in at]
        return out

    def add_expected(self, words: list[str], mass: np.ndarray) -> None:
        """Expected uses over words; those that are too long for a block are
        cut into pieces of that length, which count as words."""
        short = [w[i:i + LONGEST_IN_BLOCKS] for w in words for i in range(0, len(w), LONGEST_IN_BLOCKS)]
        for _, points in _by_length(short):
            self.expected(points, mass)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(places, code points) of the words of each length; None for long ones."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        if n > LONGEST_IN_BLOCKS:
            yield at, None
            continue
        step = max(1, LATTICE_WORDS * 8 // n)
        for part in (at[i:i + step] for i in range(0, len(at), step)):
            text = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(text, "<u4").reshape(len(part), n).astype(np.uint64)


def _count(batches: Iterator[pa.RecordBatch]):
    """mapInArrow body: (word, c, any): occurrences in training texts; words of
    held-out texts alone have none."""
    def rows(found: Counter, others: set) -> pa.RecordBatch:
        rest = [w for w in others if w not in found]
        return pa.RecordBatch.from_arrays([pa.array([*found, *rest], pa.binary()),
                                           pa.array([*found.values(), *([0] * len(rest))], pa.int64())], ["word", "c"])

    found, others = Counter(), set()
    for b in batches:
        for t, held in zip(binary_column(b, "text"), b.column(b.schema.get_field_index("held_out")).to_pylist()):
            words = (t or b"").lower().split()
            others.update(words) if held else found.update(words)
            if len(found) + len(others) > FLUSH_WORDS:
                yield rows(found, others)
                found, others = Counter(), set()
    if found or others:
        yield rows(found, others)


def _expect(shared):
    """mapInArrow body: (slot, mass) of this task's words of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        lattice = Lattice(*shared.value)
        mass = np.zeros(lattice.v.size)
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            for i in range(0, len(words), LATTICE_WORDS):
                lattice.add_expected(words[i:i + LATTICE_WORDS], mass)
        units = np.rint(mass * MASS_UNIT).astype(np.int64)
        some = np.flatnonzero(units)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(units[some])], ["slot", "mass"])
    return run


def _marginals(shared):
    """mapInArrow body: (word, c, lattice): natural logs of the marginals."""
    def run(batches: Iterator[pa.RecordBatch]):
        lattice = Lattice(*shared.value)
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lattice.marginals(words), pa.float64())],
                                             ["word", "c", "lattice"])
    return run


class Model:
    """What turns counts and marginals into log10 probabilities."""

    def __init__(self, tokens: int, distinct: int, texts: int, once: int, twice: int):
        self.tokens, self.distinct, self.texts = tokens, distinct, texts
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        # one more end keeps an end possible where no text was learned from
        self.n, self.v = tokens + 1, distinct + (texts == 0)

    def base(self, c: int) -> float:
        return math.log10((c + BASE_ADD) / (self.tokens + BASE_ADD * (self.distinct + 1)))

    def end(self) -> float:
        return math.log10((self.texts + 1 - self.discount) / self.n)

    def column(self, c, lattice):
        """log10 of a word's probability, from its count and log marginal."""
        rest = math.log(self.discount * self.v / self.n)
        seen = F.when(c > 0, F.log((c - F.lit(self.discount)) / F.lit(float(self.n))))
        top = F.greatest(seen, lattice + F.lit(rest))
        both = F.exp(lattice + F.lit(rest) - top) + F.when(c > 0, F.exp(seen - top)).otherwise(0.0)
        return (top + F.log(both)) / F.lit(math.log(10))

    def base_column(self, c):
        return F.log10((c + F.lit(BASE_ADD)) / F.lit(self.tokens + BASE_ADD * (self.distinct + 1)))


def _texts(shared, model: Model):
    """mapInArrow body: one row per text with the sums over its frequent
    words, and its other words with their numbers."""
    base_end, end, known_end = model.base(model.texts), model.end(), int(model.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]):
        frequent = shared.value
        for b in batches:
            rows, rest = [], []
            for t in binary_column(b, "text"):
                found = Counter((t or b"").lower().split())
                n, known, base, score, others = 1, known_end, [base_end], [end], []
                for w, tf in found.items():
                    n += tf
                    if (x := frequent.get(w)) is None:
                        others.append((w, tf))
                        continue
                    known += tf  # a frequent word is one of the training texts
                    base.append(tf * x[0])
                    score.append(tf * x[1])
                rows.append((n, known, math.fsum(base), math.fsum(score)))
                rest.append(others)
            n, known, base, score = zip(*rows) if rows else [()] * 4
            kind = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
            words = pa.array([[{"word": w, "tf": f} for w, f in r] for r in rest], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("held_out")),
                 pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(score, pa.float64()), words],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])
    return run


def _frequent(table: DataFrame, most: int) -> dict[bytes, tuple[float, float]]:
    """(base, p) of the words with at least as many occurrences as leave at
    most ``most`` words; words over LONGEST_IN_BLOCKS bytes are left out."""
    usual = table.where((F.col("c") > 0) & (F.octet_length("word") <= LONGEST_IN_BLOCKS))
    usual = usual.withColumn("step", F.floor(8 * F.log2("c")).cast("int"))  # at most 8 * 64 steps
    least, n = None, 0
    for r in sorted(usual.groupBy("step").count().collect(), reverse=True):
        n += r["count"]
        if n > most:
            break
        least = r["step"]
    if least is None:
        return {}
    return {bytes(r["word"]): (r["base"], r["p"]) for r in usual.where(F.col("step") >= least).select("word", "base", "p").collect()}


def learn(words: DataFrame, vocabulary: Vocabulary, rounds: int) -> np.ndarray:
    """The log masses of the pieces after ``rounds`` rounds of expected counts
    over all distinct words of the training texts (word, c)."""
    own = vocabulary.first_mass()
    logs = vocabulary.logs(own)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((vocabulary, logs))  # as large as the vocabulary
        counted = (words.where("c > 0").select("word").mapInArrow(_expect(shared), "slot int, mass long")
                   .groupBy("slot").agg(F.sum("mass").alias("mass")).collect())  # at most a row for each piece
        mass = own.copy()
        for r in counted:
            mass[r["slot"]] += r["mass"] / MASS_UNIT
        logs = vocabulary.logs(mass)
    return logs


def score(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 3, frequent_words: int = 1 << 17,
          folds: int = 10, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of the id as text
    modulo ``folds`` is ``held_fold``), n_tokens, n_known, train_tokens,
    base_score, score (log10).

    Null, empty and blank texts are one end token. Null ids have crc32 0 of no
    text, so fold 0. Words of any length and in any script are scored whole;
    bytes that are no UTF-8 can't occur in strings. Repeated rows are texts of
    their own, in the counts as well. Without training texts every word goes by
    the vocabulary's own scores. Empty tables give an empty result; other
    columns are not read. ``frequent_words``: how many of the training texts'
    most frequent words tasks hold at most; results don't depend on it."""
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    d = d.withColumn("held_out", fold == held_fold)
    texts = d.where("not held_out").count()
    words = stored(d.select("text", "held_out").mapInArrow(_count, "word binary, c long").groupBy("word")
                   .agg(F.sum("c").alias("c")), "lattice-words")
    c = F.col("c")
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(c > 0, 1)).alias("v"),
                     F.count(F.when(c == 1, 1)).alias("once"), F.count(F.when(c == 2, 1)).alias("twice")).first()
    model = Model(seen["n"] + texts, seen["v"] + (texts > 0), texts, seen["once"], seen["twice"])
    logs = learn(words, vocabulary, rounds)
    shared = spark.sparkContext.broadcast((vocabulary, logs))
    table = words.mapInArrow(_marginals(shared), "word binary, c long, lattice double")
    table = stored(table.select("word", "c", model.base_column(c).alias("base"),
                                model.column(c, F.col("lattice")).alias("p")), "lattice-table")
    held = spark.sparkContext.broadcast(_frequent(table, frequent_words))
    out = stored(d.mapInArrow(_texts(held, model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                              "base_score double, score double, rest array<struct<word:binary,tf:long>>")
                 .withColumn("row", F.monotonically_increasing_id()), "lattice-texts")
    rest = out.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.tf")
    sums = rest.join(table, "word").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.col("base")).alias("more_base"), F.sum(F.col("tf") * F.col("p")).alias("more"))
    out = out.drop("rest").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

"""Operator 7: toxicity by non-negative positive-unlabelled learning.

The classifiers are linear models over hashed words and word beginnings (inflected
words share these), each at one, two and three or more uses in the text, trained in
numpy on confirmed toxic examples (P) and unlabelled text (U) with the non-negative risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),
where ``prior`` is the share of toxic rows among the labelled training rows.  When
the bracket is negative, its gradient is stepped back, as published for this
estimator.  Several models, each on its own nine tenths of the examples, are averaged.
Features enter a model when positives hold them significantly more often than
unlabelled text does.

Bounds (documented parameters): at most about ``MAX_POSITIVE`` and ``MAX_UNLABELLED``
documents, chosen by hash at a rate set from counts over all rows, train the models,
on at most ``MAX_FEATURES`` features chosen by counts in Spark, so what reaches the
driver and the one broadcast (sampled ids) are bounded.  Scoring
covers every text, map-side.  Labels are read only where crc32(doc_id) mod 3 is not
1, and unlabelled training text comes from those rows too; nothing but the text is
an input of a score.

Defined results: a null text counts as empty and is scored by the bias; without any
positive training row all scores are 0; labels with a null ``toxic`` or ``doc_id``
are ignored, and a document labelled twice is toxic if either label says so; a null
``doc_id`` is scored and not held out; repeated rows are scored alike; a very long text is
read whole, in linear time; other columns are kept by ``score`` but for its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.shared import stage

MAX_POSITIVE = 3000
MAX_UNLABELLED = 8000
MODELS = 3
STEPS = 200
L2 = 2e-4
#: Uses of a feature that count: one, two, three or more.
USES = 3
#: Standard errors by which positives must exceed unlabelled text, and positives that must hold a feature.
LEAST_Z, LEAST_HELD = 4.0, 3
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(r"\w+")
#: Most features of a model.
MAX_FEATURES = 20_000
#: Words after which a worker's table of word features is emptied; results do not depend on it.
TABLE_WORDS = 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(w: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    crc = zlib.crc32
    return [crc(w.encode()), *(crc((w[:n] + "*").encode()) for n in PREFIXES if len(w) >= n)]


def features(text: str | None) -> np.ndarray:
    """Sorted ``USES * hash + uses - 1`` of every feature of a text, uses capped at ``USES``."""
    uses: Counter = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for f in word_features(w):
            uses[f] += n
    return np.sort(np.fromiter((USES * f + min(n, USES) - 1 for f, n in uses.items()), np.int64, len(uses)))


def _spread(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(feature keys, row numbers): a feature used n times is there at 1 .. n uses."""
    key = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keys, at = [], []
    for less in range(USES):
        on = key % USES >= less
        keys.append(key[on] - key[on] % USES + less)
        at.append(row[on])
    return np.concatenate(keys), np.concatenate(at)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


class Rows:
    """Sparse binary rows over the chosen features."""

    def __init__(self, key: np.ndarray, row: np.ndarray, chosen: np.ndarray, n: int):
        at = np.searchsorted(chosen, key)
        on = (at < len(chosen)) & (chosen[np.minimum(at, max(0, len(chosen) - 1))] == key) if len(chosen) else np.zeros(len(key), bool)
        self.at, self.row, self.n = at[on], row[on], n

    def score(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n) + b

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def choose(sample: DataFrame, n_pos: int, n_unl: int) -> list[int]:
    """Feature keys that positives of the sample hold significantly more often, counted in Spark."""
    # A feature used n times is there at 1 .. n uses.
    at = F.explode(F.sequence(F.col("f") - F.col("f") % USES, "f"))
    keys = sample.select(F.explode("f").alias("f"), "pos", "unl").select(at.alias("key"), "pos", "unl")
    held = keys.groupBy("key").agg(F.sum(F.col("pos").cast("long")).alias("p"), F.sum(F.col("unl").cast("long")).alias("u")).where(F.col("p") >= LEAST_HELD)
    both = (F.col("p") + F.col("u")) / (n_pos + n_unl)
    z = (F.col("p") / n_pos - F.col("u") / n_unl) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl) + 1e-12)
    best = held.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "key").limit(MAX_FEATURES)
    return sorted(r["key"] for r in best.select("key").collect())


def as_negative(s: np.ndarray) -> float:
    """Mean logistic loss of scores if all were negative."""
    return float(-np.log1p(-np.minimum(s, 1 - 1e-12)).mean())


def slopes(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the risk by the raw scores of positives and of unlabelled rows, given their probabilities; where
    the bracket is negative, those of the bracket alone, turned round."""
    # Logistic loss: d loss(+)/dx = s - 1, d loss(-)/dx = s.
    if as_negative(su) - prior * as_negative(sp) >= 0:
        return -prior * np.ones(len(sp)) / len(sp), su / len(su)
    return prior * sp / len(sp), -su / len(su)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray) -> tuple[dict[int, float], float]:
    """(weight of each chosen feature key, bias): the mean of ``MODELS`` models."""
    weights: dict[int, float] = {}
    bias = 0.0
    for k in range(MODELS):
        rng = np.random.default_rng(k)
        some = lambda rows: [rows[i] for i in np.sort(rng.permutation(len(rows))[: math.ceil(0.9 * len(rows))])]
        p, u = some(positive), some(unlabelled)
        (pk, pr), (uk, ur) = _flat(p), _flat(u)
        n, xp, xu = len(chosen), Rows(pk, pr, chosen, len(p)), Rows(uk, ur, chosen, len(u))
        w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        w[n] = math.log(prior / (1 - prior))
        for step in range(1, STEPS + 1):
            sp, su = sigmoid(xp.score(w[:n], w[n])), sigmoid(xu.score(w[:n], w[n]))
            gp, gu = slopes(sp, su, prior)
            g = np.append(xp.back(gp, n) + xu.back(gu, n), gp.sum() + gu.sum())
            g[:n] += L2 * w[:n]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        for key, x in zip(chosen.tolist(), (w[:n] / MODELS).tolist(), strict=True):
            weights[key] = weights.get(key, 0.0) + x
        bias += float(w[n]) / MODELS
    return weights, bias


class Scorer:
    """Scores texts; remembers for each word the features that carry weight."""

    def __init__(self, weights: dict[int, float], bias: float):
        steps: dict[int, list[float]] = {}
        for key, x in weights.items():
            steps.setdefault(key // USES, [0.0] * USES)[key % USES] = x
        self.sums = {f: np.cumsum(x).tolist() for f, x in steps.items()}
        self.bias, self.table = bias, {}

    def raw(self, text: str | None) -> float:
        table, sums, hits = self.table, self.sums, []
        if len(table) > TABLE_WORDS:
            table.clear()
        for w in WORD.findall((text or "").lower()):
            got = table.get(w)
            if got is None:
                got = table[w] = tuple(f for f in word_features(w) if f in sums)
            if got:
                hits += got
        # fsum: the order in which features turn up must not show in the score
        return math.fsum([self.bias, *(sums[f][min(n, USES) - 1] for f, n in Counter(hits).items())])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[dict[int, float], float] | None:
    """The model, or None without positive training rows."""
    use = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = use.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return None
    prior = min(0.5, max(0.001, toxic / n))
    train_docs = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    rows = train_docs.count()
    share = lambda seed, rate: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, rate) * (1 << 30))
    chosen = use.where((F.col("toxic") == 1) & share(1, max_positive / toxic)).select(F.col("doc_id").alias("p"))
    picked = train_docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("p"), "left")
    picked = picked.select("text", F.col("p").isNotNull().alias("pos"), share(2, max_unlabelled / max(1, rows)).alias("unl")).where("pos OR unl")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            f = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int64())), b.column("pos"), b.column("unl")], ["f", "pos", "unl"])

    sample, _ = stage(spark, picked.mapInArrow(run, "f array<bigint>, pos boolean, unl boolean"), "sample")
    n_pos, n_unl = sample.agg(F.sum(F.col("pos").cast("long")), F.sum(F.col("unl").cast("long"))).first()
    if not n_pos or not n_unl:
        return None
    keys = choose(sample, n_pos, n_unl)

    def reduce(batches):
        import pyarrow as pa

        known = np.array(keys, np.int64)
        for b in batches:
            rows = []
            for x in b.column("f"):
                key, _ = _spread([np.asarray(x.values)])
                rows.append(np.sort(key[np.isin(key, known)]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), b.column("pos"), b.column("unl")], ["f", "pos", "unl"])

    got = sample.mapInArrow(reduce, "f array<bigint>, pos boolean, unl boolean").toArrow()
    f = [np.asarray(x.values) if x.values is not None else np.zeros(0, np.int64) for x in got.column("f")]
    pos, unl = got.column("pos").to_pylist(), got.column("unl").to_pylist()
    # The order of collected rows varies; that of the sums must not.
    in_order = lambda on: sorted((x for x, y in zip(f, on, strict=True) if y), key=lambda x: (len(x), x.tobytes()))
    return train(in_order(pos), in_order(unl), prior, np.array(keys, np.int64))


def score(docs: DataFrame, model: tuple[dict[int, float], float] | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score``."""
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (text, "score")), F.col(f"`{text}`").alias("__text"))
    if model is None:
        return source.drop("__text").withColumn("score", F.lit(0.0))
    weights, bias = model
    schema = source.drop("__text").withColumn("score", F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(weights, bias)
        for b in batches:
            kept = [n for n in b.schema.names if n != "__text"]
            raw = np.array([scorer.raw(t.as_py()) for t in b.column("__text")], np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sigmoid(raw))], [*kept, "score"])

    return source.mapInArrow(run, schema)


def toxicity_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(spark, docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

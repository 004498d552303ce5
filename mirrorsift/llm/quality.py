"""Quality classification by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled quality 1; the unlabelled set is web text whatever its label.  The
class prior is estimated as the smallest ratio of unlabelled to positive mass over upper level sets of a
first positive-against-unlabelled score (no set can hold more positives than the unlabelled text has).
A linear model of text statistics and of word frequencies, hashed to LEXICAL buckets, then minimises

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),   l(g) = log(1 + exp(-g)),

stepping back on the second part alone where it would turn negative.  The logistic loss makes sigmoid(g)
a probability.  Negative labels, lang, source and doc_id are never used by a score.

The fit sees at most MAX_POSITIVES and MAX_UNLABELLED rows, taken by hash among those that are not held
out; only their statistics (numbers) come to the driver.  Every whole text is scored, in blocks.

Defined results: null texts are empty; a null doc_id counts as held out; conflicting labels of a doc_id
make it no positive; without positives or unlabelled rows every score is 0.5; repeated rows get repeated
results; extra columns are ignored by score() and kept by keep(); empty tables give no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.llm.words import encoded, word_blocks
from mirrorsift.runtime import configure, spread

MAX_POSITIVES = 10_000
MAX_UNLABELLED = 20_000
FOLDS = 5
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 800, 0.08, 1e-4


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


CLASSES = np.stack([
    _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"abcdefghijklmnopqrstuvwxyz"), _class(b"0123456789"), _class(b".,;:?"), _class(b"!"), _class(b"|"),
    _class(b"#$%&*@^~_=+<>{}[]\\/`"), _class(b"\n"), _class(bytes(range(128, 256))), _class(b"'\"()-"),
])
N_STATISTICS, LEXICAL = 15, 64
N_FEATURES = N_STATISTICS + LEXICAL


class Buckets(dict):
    """The bucket of each word, whatever its case; forgotten when there are too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower()) % LEXICAL
        return value


_BUCKETS = Buckets()


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text and the frequencies of its words' buckets; zeros for a text without words."""
    data = encoded(text)
    n = same = longest = 0
    held = np.zeros(LEXICAL)
    kinds, weight = 0.0, 0
    last = None
    for words in word_blocks(data):
        if not words:
            continue
        same += sum(map(operator.eq, words, words[1:])) + (last == words[0])
        last = words[-1]
        held += np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), dtype=np.int64, count=len(words)), minlength=LEXICAL)
        n += len(words)
        longest = max(longest, max(map(len, words)))
        kinds += len(words) * np.log(len(set(words)) + 1) / np.log(len(words) + 1)
        weight += len(words)
    if not n:
        return np.zeros(N_FEATURES)
    upper, lower, digit, stop, bang, pipe, symbol, line, high, quote = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ CLASSES.T
    share = np.array([digit, stop, bang, pipe, symbol, line, quote, same]) / n
    return np.concatenate([
        np.log1p(20 * share),
        [np.log1p(n), (upper + lower + digit + high) / n, kinds / weight, np.log1p(longest), upper / max(1.0, upper + lower), high / len(data), np.log1p(20 * abs(upper - stop) / n)],
        np.log1p(20 * held / n),
    ])


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, floor: float = 0.2) -> float:
    """The share of positives in the unlabelled scores: the least U(s >= t) / P(s >= t) where P keeps ``floor``."""
    cuts = np.quantile(pos, np.linspace(0, 1 - floor, 200))
    p = np.array([(pos >= t).mean() for t in cuts])
    u = np.array([(unl >= t).mean() for t in cuts])
    slack = 2 * np.sqrt(u * (1 - u) / len(unl) + p * (1 - p) / len(pos))
    return float(np.clip(np.min((u + slack) / np.maximum(p, 1e-9)), 0.05, 0.99))


class Model:
    """Standardised linear scores; a plain picklable object."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model | None:
    """The model of least non-negative risk, or None without data."""
    if not len(pos) or not len(unl):
        return None
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-9] = 1.0
    # all buckets together weigh as much as one statistic, so that the ridge holds them back
    scale[N_STATISTICS:] *= np.sqrt(LEXICAL)
    design = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = design(pos), design(unl)

    def descend(gradient) -> np.ndarray:
        w, adam = np.zeros(p.shape[1]), Adam(p.shape[1], RATE)
        for _ in range(STEPS):
            w = adam.step(w, gradient(w) + RIDGE * w)
        return w

    # positives against unlabelled text, for the prior
    first = descend(lambda w: -(_sigmoid(-(p @ w)) @ p) / len(p) + (_sigmoid(u @ w) @ u) / len(u))
    prior = estimate_prior(p @ first, u @ first)

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        negative = _softplus(gu).mean() - prior * _softplus(gp).mean()
        grad_negative = (_sigmoid(gu) @ u) / len(u) - prior * (_sigmoid(gp) @ p) / len(p)
        if negative < 0:
            return -grad_negative
        return -prior * (_sigmoid(-gp) @ p) / len(p) + grad_negative

    return Model(mean, scale, descend(risk_gradient), prior)


def _held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _share(wanted: int, n: int, col: str, seed: int):
    """A filter by hash that keeps about ``wanted`` of n rows."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(col)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on bounded samples of docs (doc_id, text) and labels (doc_id, quality)."""
    configure(docs.sparkSession)
    trusted = labels.where(~_held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    n_trusted, n_docs = trusted.count(), docs.count()
    trusted = trusted.where(_share(MAX_POSITIVES, n_trusted, "doc_id", 1)).limit(2 * MAX_POSITIVES).withColumn("positive", F.lit(True))
    rows = spread(docs).select("doc_id", F.col("text").cast("string").alias("text")).where(~_held_out("doc_id"))
    # at most twice MAX_POSITIVES ids: a bounded broadcast
    rows = rows.join(F.broadcast(trusted), "doc_id", "left").withColumn("unlabelled", _share(MAX_UNLABELLED, n_docs, "doc_id", 2)).where("positive or unlabelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, type=pa.binary())], names=["positive", "unlabelled", "x"])

    sample = rows.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), "unlabelled").mapInArrow(run, "positive boolean, unlabelled boolean, x binary").toPandas()
    take = lambda c: np.frombuffer(b"".join(sample.loc[sample[c], "x"])).reshape(-1, N_FEATURES)
    order = lambda x: x[np.lexsort(x.T[::-1])]  # noqa: E731  the same sums whatever the order of tasks
    return fit(order(take("positive")), order(take("unlabelled")))


def _scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None or not len(texts):
        return np.full(len(texts), 0.5)
    return model.score(np.stack([features(t.as_py()) for t in texts]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    configure(docs.sparkSession)
    rows = spread(docs).select(F.col(id_col).alias("doc_id"), _held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1, without a shuffle."""
    configure(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), model) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def auc(truth: pd.Series, scores: pd.Series) -> float:
    """Area under the ROC curve, ties counted half."""
    rank = scores.rank()
    n1 = int((truth == 1).sum())
    n0 = len(truth) - n1
    return float((rank[truth == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")

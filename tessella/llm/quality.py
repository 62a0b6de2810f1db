"""Quality classifier: Bradley-Terry ranking of documents, thresholded at a score quantile.

A document's strength is linear in features of its text. Preference pairs (a document labelled good, one labelled
bad) give logistic losses on feature differences; their minimum is the Bradley-Terry fit. The decision threshold is
the quantile of the labelled documents' strengths at the share of bad labels; the score maps strengths through a
logistic curve in which that threshold has the score ``CUT``.

The weights are learnt from a bounded sample of the labelled rows (``MAX_LABELLED`` of each label, those with the smallest
hash of the id); share, threshold and slope come from all labelled documents (exact order statistics, found in Spark), and
scoring covers every row. Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts get the score of a text without evidence (shrunken features, all zero); labels
other than 0 and 1 and labels without a document are ignored; a document with several labels counts with each; of
documents that share an id one is learnt from; with
no pair to learn from, every document scores 0.5 and is kept; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, slices

CUT = 0.3
MAX_LABELLED = 6000
PAIRS = 60_000
#: Words after which a text's features count half.
HALF_EVIDENCE = 8.0

_ASCII = bytes(range(128))
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b".,;:!?'\"()-"
_SYMBOLS = bytes(c for c in range(128) if c not in _LETTERS + _DIGITS + _SPACE + _MARKS)
_SENTENCE_END = re.compile(rb"[.?!](?=\s|$)")
N_FEATURES = 13
#: Values of a distributed order statistic that the driver sorts at last.
FEW = 10_000


def features(text: str | None) -> list[float]:
    """Shape of a text: lengths, shares of kinds of characters, repetition of words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    tokens = raw.split()
    if not tokens:
        return [0.0] * N_FEATURES + [0.0]
    share = lambda kind: (n - len(raw.translate(None, kind))) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = len(tokens)
    same = sum(map(bytes.__eq__, tokens, tokens[1:]))
    return [
        math.log1p(n), share(_LETTERS), share(_SYMBOLS), share(_UPPER), share(_DIGITS), raw.count(b"!") / k, raw.count(b"|") / k,
        len(set(tokens)) / math.pow(k, 0.9), same / k, len(set(lines)) / len(lines), n / k, len(_SENTENCE_END.findall(raw)) / k, math.log1p(len(lines)), float(k),
    ]


class Ranker:
    """Standardisation, Bradley-Terry weights, threshold and slope of the score."""

    def __init__(self, mean, scale, weights, threshold, slope):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x[:, :N_FEATURES] - self.mean) / self.scale, -6, 6)
        z *= (x[:, N_FEATURES] / (x[:, N_FEATURES] + HALF_EVIDENCE))[:, None]
        return np.hstack([z, z * z / 4])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        at_cut = math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold) + at_cut, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = 400, ridge: float = 1e-4) -> Ranker:
    """Bradley-Terry fit on pairs of a good and a bad row of ``x``; pairs cover the rows evenly."""
    if not good.any() or good.all():
        return Ranker(None, None, None, 0.0, 1.0)
    model = Ranker(x[:, :N_FEATURES].mean(0), x[:, :N_FEATURES].std(0) + 1e-9, None, 0.0, 1.0)
    z, rng = model._expand(x), np.random.default_rng(20)
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    difference = z[np.resize(rng.permutation(win), pairs)] - z[rng.permutation(np.resize(lose, pairs))]
    weights, momentum = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        momentum = 0.9 * momentum + (difference.T @ miss / pairs - ridge * weights)
        weights = weights + 0.2 * momentum
    model.weights = weights
    strength = model.strength(x)
    model.threshold = float(np.quantile(strength, (~good).mean()))
    model.slope = 1.0 / max(1e-6, float(np.median(np.abs(strength - model.threshold))) / 3)
    return model


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 0)):
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "good", "_id"])


def order_statistic(values: DataFrame, column: str, rank: int) -> float:
    """The exact value at ``rank`` (from 0) of a column of finite doubles: bins around it are counted until few values are left."""
    rest = values.select(F.col(column).alias("v"))
    while True:
        low, high, n = rest.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if n <= FEW or low == high:
            return low if low == high else sorted(r.v for r in rest.collect())[rank]
        place = F.least(F.floor((F.col("v") - low) / (high - low) * 1024), F.lit(1023)).cast("int")
        for at, size in sorted(map(tuple, rest.groupBy(place.alias("bin")).count().collect())):
            if rank < size:
                break
            rank -= size
        rest = rest.filter(place == at)


def quantile(values: DataFrame, column: str, n: int, share: float) -> float:
    """The exact quantile of ``n`` values, between two of them in proportion (as numpy does by default)."""
    at = (n - 1) * share
    low = order_statistic(values, column, math.floor(at))
    high = order_statistic(values, column, math.ceil(at)) if at % 1 else low
    return low + (high - low) * (at % 1)


def calibrate(model: Ranker, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> Ranker:
    """Threshold and slope from the strengths of all documents labelled in ``rows`` (``_id, good``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, N_FEATURES + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.strength(x), pa.float64())], ["_id", "strength"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    strengths = texts.mapInArrow(run, f"_id {texts.schema['_id'].dataType.simpleString()}, strength double")  # before the join, so that no text is shuffled
    labelled = materialize(strengths.join(rows, "_id").select("strength", "good"), "strengths")
    n, bad = labelled.agg(F.count("*"), F.sum(1 - F.col("good"))).first()
    model.threshold = quantile(labelled, "strength", n, bad / n)
    spread = labelled.select(F.abs(F.col("strength") - model.threshold).alias("d"))
    model.slope = 1.0 / max(1e-6, quantile(spread, "d", n, 0.5) / 3)
    drop_table(labelled)
    return model


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", keep=None) -> Ranker:
    """Weights from at most ``max_labelled`` rows of each label, threshold and slope from all. ``keep``: a Column on the label's id that admits it."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("good")).filter("good IN (0, 1) AND _id IS NOT NULL")
    if keep is not None:
        rows = rows.filter(keep(F.col("_id")))
    each = [rows.filter(f"good = {g}").orderBy(F.xxhash64("_id"), "_id").limit(max_labelled) for g in (0, 1)]
    sample = F.broadcast(each[0].unionByName(each[1]))  # 2 * max_labelled small rows
    drawn = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(sample, "_id")
    shapes = drawn.select("text", "good", "_id").mapInArrow(_featuriser, f"x array<double>, good int, _id {drawn.schema['_id'].dataType.simpleString()}")
    got = shapes.groupBy("_id", "good").agg(F.min("x").alias("x")).toPandas()  # one row for each id and label, however many documents share it
    if not len(got):
        return Ranker(None, None, None, 0.0, 1.0)
    x = np.array(got["x"].tolist(), float)
    order = np.lexsort([*x.T[::-1], got["good"].to_numpy()])  # arrival order must not matter
    model = fit(x[order], got["good"].to_numpy()[order] == 1)
    return model if model.weights is None else calibrate(model, docs, rows, id_col, text_col)


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, N_FEATURES + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")


def keep_good(docs: DataFrame, model: Ranker, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``cut``, with all their columns."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, where)):
            x = np.array([features(t) for t in batch.column(where).to_pylist()], float).reshape(-1, N_FEATURES + 1)
            yield batch.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)

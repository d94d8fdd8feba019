"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows from which the model is fitted: trusted positives, unlabelled texts, and rows for the class prior.
FIT_ROWS = 6000
PIECE = 1 << 22
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
N_FEATURES = len(_PUNCT) + 21


def _tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than white space."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([0], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [0])).astype(np.int8)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def features(text: str) -> np.ndarray:
    """Shares of character classes, punctuation, word shapes and repeated lines or words of a whole text."""
    data = text.encode()
    out = np.zeros(N_FEATURES)
    n = len(data)
    if not n:
        out[-1] = 1.0
        return out
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(256, np.int64)
    for a in range(0, n, PIECE):
        counts += np.bincount(raw[a : a + PIECE], minlength=256)
    k = len(_PUNCT)
    out[:k] = counts[_PUNCT] / n
    upper, lower, digit = counts[_UPPER].sum(), counts[_LOWER].sum(), counts[_DIGIT].sum()
    start, end = _tokens(data)
    words = max(1, len(start))
    size = end - start
    punct = np.zeros(256, bool)
    punct[_PUNCT] = True
    if len(start):
        first, last, before = raw[start], raw[end - 1], raw[np.maximum(end - 2, start)]
        sym_last = punct[last] & ~np.isin(last, np.frombuffer(b".,;:?'\")", np.uint8))
        shape = [
            size.mean() / 10, size.std() / 10, (size > 20).mean(), (size == 1).mean(), sym_last.mean(), (punct[last] & punct[before]).mean(), (punct[first] & (size == 1)).mean(),
            ((first >= 65) & (first <= 90)).mean(), (np.isin(last, np.frombuffer(b".?!", np.uint8))).mean(),
        ]
    else:
        shape = [0.0] * 9
    lines = [x for x in data.split(b"\n") if x.strip()]
    tokens = data.split()
    out[k : k + 20] = [
        np.log1p(n) / 10, upper / n, lower / n, digit / n, counts[128:].sum() / n, counts[10] / n, counts[32] / n, upper / max(1, upper + lower), *shape,
        1 - len(set(lines)) / max(1, len(lines)), len(set(tokens)) / words, sum(map(eq, tokens, tokens[1:])) / words,
    ]
    return out


@dataclass
class Model:
    """A logistic model over standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z**2 / 4, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -50, 50)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.04, decay: float = 1e-4) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss.

    The risk is prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); where the second part goes
    below zero, a step lowers its violation instead. Full-batch Adam from zero, so the fit is deterministic.
    """
    both = np.concatenate([positives, unlabelled]) if len(positives) + len(unlabelled) else np.zeros((1, N_FEATURES))
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-3, np.zeros(2 * both.shape[1] + 1), prior)
    if not len(positives) or not len(unlabelled):
        return model
    p, u = model.expand(positives), model.expand(unlabelled)
    m = v = np.zeros(p.shape[1])
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -50, 50)))
    for t in range(1, steps + 1):
        sp, su = p @ model.weights, u @ model.weights
        up, uu = sigmoid(sp), sigmoid(su)
        grad_plus = -prior * p.T @ (1 - up) / len(p)
        grad_minus = u.T @ uu / len(u) - prior * p.T @ up / len(p)
        risk_minus = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        grad = (grad_plus + grad_minus if risk_minus >= 0 else -grad_minus) + decay * model.weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        model.weights = model.weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def _feature_rows(df: DataFrame, text_col: str) -> DataFrame:
    @F.arrow_udf(T.BinaryType())
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t.as_py() or "").tobytes() for t in batch], pa.binary())

    return df.select(extract(F.col(text_col)).alias("x"))


def _collect(df: DataFrame, text_col: str) -> np.ndarray:
    rows = _feature_rows(df, text_col).toArrow().column(0).to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, N_FEATURES) if rows else np.zeros((0, N_FEATURES))


def train(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on trusted positives and unlabelled texts, at most ``fit_rows`` different rows of each, chosen by a hash of the id.

    ``labels`` must hold training rows only. Its positives are the trusted ones; texts count as unlabelled whatever
    their label. The class prior is the share of positives among all rows of ``labels``, as they are a
    sample of the web texts. Null labels and ids are left out; without positives the score is 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("known_id"), F.col(label_col).alias("known"))
    n, n_positive = known.agg(F.count("*"), F.count_if(F.col("known") == 1)).first()
    prior = min(0.98, max(0.02, n_positive / n)) if n else 0.5
    chosen = known.where("known = 1").orderBy(F.xxhash64("known_id"), "known_id").limit(fit_rows).select("known_id")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("of"))

    def bounded(some: DataFrame, salt: int) -> DataFrame:
        """At most ``fit_rows`` of the different rows, by a hash of the id; only these are collected."""
        picks = some.select("id", "of").distinct().orderBy(F.xxhash64("id", F.lit(salt)), "id", "of").limit(fit_rows)
        return some.join(picks, ["id", "of"], "left_semi").dropDuplicates(["id", "of"])

    positives = bounded(rows.join(chosen, rows.id == chosen.known_id, "left_semi"), 3)
    unlabelled = bounded(rows.where("id is not null"), 7)
    return fit(_collect(positives, "body"), _collect(unlabelled, "body"), prior)


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the model's score (0 to 1) of each whole text; null counts as empty, which has a score as well."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch, "")
            scores = []
            for a in range(0, len(texts), 512):
                scores.append(model.score(np.stack([features(t.as_py()) for t in texts.slice(a, 512)])))
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return df.withColumn(out_col, run(F.col(text_col)))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a row is in the fold that is never trained on: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Add ``held_out`` (boolean), ``score`` (double) and ``predicted`` (int, 1 if score >= ``threshold``).

    The model learns from texts and labels of rows outside the held-out fold alone; no other column is an input of
    a score. Rows stay as they are, repeats and null ids included (a null id is not held out and trains
    nothing); existing columns of the three names are replaced; an empty table gives an empty table.
    """
    model = train(df.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, label_col, fit_rows)
    out = score(df.drop("held_out", "score", "predicted"), model, text_col)
    return out.withColumns({"held_out": F.coalesce(held_out(id_col), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})

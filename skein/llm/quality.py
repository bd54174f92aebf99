"""Operator 3: a regularised quadratic discriminant over transformed statistics of a document.

Every text is measured (lengths, shares of kinds of characters, repetition of words, neighbours and lines, compression),
each figure is transformed to be roughly normal and standardised.  Each class has a mean and a covariance, shrunk toward
the pooled one and toward its diagonal; the shrinkage is chosen by cross-validated likelihood of the labels.  The score
is a logistic function of the difference of the classes' log densities, from Mahalanobis lengths by Cholesky factors
that the fit keeps.

Defined cases: null and empty texts are measured as texts of no words.  Each row is scored, rows that repeat alike; a null
doc_id is not held out.  Columns beside doc_id and text are not read, whatever their names.  An empty table gives no rows.
With fewer than ten labelled rows of either class the score is
the share of good labels (1 without any).  Only the fit looks at a sample, of a bounded number of labelled rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_text, release
from .labelled import SAMPLE_ROWS, logistic, sample, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER, _DIGITS, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\n\v\f"
_STOPS, _SIGNS = b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~"
_COMPRESSED = 1 << 16


def statistics(text: str) -> list[float]:
    """The transformed figures of one whole text."""
    data, words = text.encode("utf-8", "surrogatepass"), text.split()
    n, m = len(data) or 1, len(words) or 1
    left = lambda kinds: len(data) - len(data.translate(None, kinds))
    share = lambda k, of: float(np.arcsin(np.sqrt(min(1.0, k / of))))
    counts, lines = Counter(words), text.split("\n")
    top = counts.most_common(1)[0][1] if counts else 0
    repeated = sum(map(str.__eq__, words, words[1:])) if m > 1 else 0
    full = [x for x in lines if x.strip()]
    squeezed = sum(len(zlib.compress(data[at : at + _COMPRESSED], 1)) for at in range(0, len(data), _COMPRESSED))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    pairs = Counter(zip(words, words[1:], strict=False)) if m > 1 else {}
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        share(left(_UPPER), max(left(_LETTERS), 1)),
        share(left(_DIGITS), n),
        share(left(_STOPS), n),
        share(left(_SIGNS), n),
        share(data.count(b"|"), m),
        share(data.count(b"!"), n),
        share(len(data) - len(text), n),
        share(left(_SPACE), n),
        float(np.log(len(counts) + 1) / np.log(m + 1.5)),
        share(top, m),
        share(repeated, m),
        share(max(pairs.values(), default=0), m),
        share(len(full) - len(set(full)), len(full) or 1),
        float(np.log1p(len(text) / len(lines))),
        float(np.log((squeezed + 8) / (n + 8))),
        float(np.log1p(lengths.max())),
    ]


FIGURES = len(statistics(""))


class Discriminant:
    """Means, Cholesky factors and log determinants of the classes, and the scale and shift of the score."""

    def __init__(self, centre, spread, means, covariances):
        self.centre, self.spread, self.means = centre, spread, means
        self.factors = [np.linalg.cholesky(c) for c in covariances]
        self.inverse = [np.linalg.inv(f) for f in self.factors]
        self.log_det = [2 * np.log(np.diag(f)).sum() for f in self.factors]
        self.scale, self.shift = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0."""
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        dense = [-0.5 * ((((z - m) @ inv.T) ** 2).sum(1) + d) for m, inv, d in zip(self.means, self.inverse, self.log_det, strict=True)]
        return dense[1] - dense[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * squash(self.difference(x)) + self.shift)


def squash(d: np.ndarray) -> np.ndarray:
    return np.arcsinh(d / 4) * 4


def shrunk(z: np.ndarray, y: np.ndarray, to_pooled: float, to_diagonal: float) -> tuple[list, list]:
    means = [z[y == k].mean(0) for k in (0, 1)]
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(own))
    out = []
    for c in own:
        c = (1 - to_pooled) * c + to_pooled * pooled
        out.append((1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c)))
    return means, out


GRID = [(a, b) for a in (0.02, 0.1, 0.3, 0.6) for b in (0.01, 0.1, 0.3)]


def fit_arrays(x: np.ndarray, y: np.ndarray, folds: int = 5) -> Discriminant:
    """Shrinkage, scale and shift by likelihood over ``folds`` parts of the rows."""
    centre, spread = x.mean(0), x.std(0) + 1e-6
    part, best = np.arange(len(y)) % folds, None
    for to_pooled, to_diagonal in GRID:
        d = np.zeros(len(y))
        for k in range(folds):
            z = np.clip((x[part != k] - centre) / spread, -8, 8)
            d[part == k] = Discriminant(centre, spread, *shrunk(z, y[part != k], to_pooled, to_diagonal)).difference(x[part == k])
        w = logistic(squash(d)[:, None], y, ridge=1e-3)
        p = np.clip(sigmoid(w[0] * squash(d) + w[1]), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = loss, to_pooled, to_diagonal, w
    model = Discriminant(centre, spread, *shrunk(np.clip((x - centre) / spread, -8, 8), y, *best[1:3]))
    model.scale, model.shift = float(best[3][0]), float(best[3][1])
    return model


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Discriminant | Constant:
    """A model from at most ``rows`` labelled documents; only their figures reach the driver."""
    arrow = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    chosen = sample(docs, labels, "quality", FOLDS, HELD_OUT, rows).withColumn("text", F.concat(F.col("label").cast("string"), F.coalesce("text", F.lit(""))))
    measured = map_text(chosen, lambda ids, texts: [ids, [[float(t[:1]), *statistics(t[1:])] for t in texts]], "doc_id long, x array<double>", arrow)
    got = sorted((r["doc_id"], list(r["x"])) for r in measured.collect())
    a = np.array([x for _, x in got], float).reshape(len(got), FIGURES + 1)
    y = a[:, 0]
    if len(y) == 0 or min(y.sum(), (1 - y).sum()) < 10:
        return Constant(float(y.mean()) if len(y) else 1.0)
    return fit_arrays(a[:, 1:], y)


def score(docs: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    out = map_text(docs, lambda ids, texts: [ids, model.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), FIGURES))], "doc_id long, score double", arrow)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_column(model):
    """The score as a function of a text column, for filters that keep all other columns where they are."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = model.score(np.array([statistics(t or "") for t in texts], float).reshape(len(texts), FIGURES))
        release()
        return pd.Series(out, index=texts.index, dtype=float)

    return scored

"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian of the transformed statistics, its covariance shrunk towards the
pooled one and towards a multiple of the identity.  Means and covariances come from sums of the
labelled rows that Spark adds up; the factors are inverted once and scoring is one
product per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import blocks_of_text, held_out
from commutelens.session import cut

FOLDS = 5
ACCEPT = 0.3
TO_POOLED, TO_IDENTITY = 0.2, 0.02
REACH = 4.0
"""Statistics count no further from the mean of all labelled rows than so many deviations."""

NAMES = [
    "words", "letters", "upper", "digits", "symbols", "marks", "stops", "lines", "wide",
    "distinct_words", "repeated_windows", "repeated_lines",
]


def _select(letters: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(letters)] = 1
    return out


CLASSES = np.stack([
    _select(bytes(range(65, 91))), _select(bytes(range(48, 58))), _select(b"#*$%&|<>"),
    _select(b"!?"), _select(b".,;:"), _select(b"\n"), _select(bytes(range(128, 192))),
    _select(b" \t\n\x0b\f\r"),
], 1)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole UTF-8 text; zeros for an empty one."""
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * len(NAMES)
    upper, digits, symbols, marks, stops, lines, tails, blanks = (
        np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES
    )
    letters = len(text) - tails - blanks
    whole = [x for x in text.split(b"\n") if x.strip()]
    windows = len(set(zip(found, found[1:], found[2:])))
    return [
        np.log1p(n),
        np.log1p(letters / n),
        np.log1p(100 * upper / letters),
        np.log1p(100 * digits / letters),
        np.log1p(100 * symbols / n),
        np.log1p(100 * marks / n),
        np.log1p(100 * stops / n),
        np.log1p(100 * lines / n),
        np.log1p(100 * tails / letters),
        len(set(found)) / n,
        1 - windows / max(n - 2, windows, 1),
        1 - len(set(whole)) / len(whole),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics ``v`` of its text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[float(x) for x in statistics(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "v"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return blocks_of_text(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, v array<double>")


@dataclass(frozen=True)
class Model:
    """Log odds of the classes, and for each its mean, inverted factor and log determinant."""

    prior: float
    low: np.ndarray
    high: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        odds = np.full(len(x), self.prior)
        if self.classes:
            x = np.clip(x, self.low, self.high)
            for sign, (mean, inverse, log_det) in zip((-1, 1), self.classes):
                z = (x - mean) @ inverse.T
                odds = odds + sign * (-0.5 * (z * z).sum(1) - log_det)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By label: rows, mean and covariance of ``v``, from sums that Spark adds up."""
    d = len(NAMES)
    v = [F.col("v")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x) for x in v]).alias("s"),
        F.array(*[F.sum(v[i] * v[j]) for i, j in pairs]).alias("p"),
    )
    out = {}
    for row in sums.collect():  # one row per label
        mean, cov = np.array(row["s"]) / row["n"], np.zeros((d, d))
        for (i, j), x in zip(pairs, row["p"]):
            cov[i, j] = cov[j, i] = x / row["n"] - mean[i] * mean[j]
        out[row["label"]] = row["n"], mean, cov
    return out


def fit(described: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """A model from the rows of ``labels (doc_id, quality)`` outside fold 0.

    Rows without an id or a quality of 0 or 1 teach nothing; an id labelled twice
    counts twice.  Unless both classes have two rows, the score is their share (0.5 without
    any) for each text.
    """
    rows = cut(
        described.join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label")), "doc_id")
        .where(~held_out("doc_id", folds))
        .select("label", "v"),
        "qda-labelled",
    )
    first = _moments(rows)
    n = {c: first[c][0] if c in first else 0 for c in (0, 1)}
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n.values()) < 2:
        return Model(prior, np.zeros(0), np.zeros(0), ())
    every = n[0] + n[1]
    mean = sum(n[c] * first[c][1] for c in n) / every
    spread = sum(n[c] * (np.diag(first[c][2]) + (first[c][1] - mean) ** 2) for c in n) / every
    reach = REACH * np.sqrt(np.maximum(spread, 1e-6))
    low, high = mean - reach, mean + reach
    inside = [
        F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.col("v")[i])) for i, (a, b) in enumerate(zip(low, high))
    ]
    second = _moments(rows.select("label", F.array(*inside).alias("v")))
    pooled = sum(n[c] * second[c][2] for c in n) / every
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    classes = []
    for c in (0, 1):
        # in units of the pooled deviations, so that the identity means the same for each
        own = (1 - TO_POOLED) * second[c][2] + TO_POOLED * pooled
        own = own / np.outer(scale, scale)
        own = (1 - TO_IDENTITY) * own + TO_IDENTITY * max(np.trace(own) / len(own), 1e-3) * np.eye(len(own))
        factor = np.linalg.cholesky(own) * scale[:, None]
        classes.append((second[c][1], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Model(prior, low, high, tuple(classes))


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs (doc_id, text)``.

    Only the text goes into a score.  Other columns are ignored; repeated rows get the same
    score; a null id is in no fold and no label's; an empty table gives an empty one.
    """
    slim = cut(described(docs), "qda-statistics")
    model = fit(slim, labels, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= accept).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    scored = slim.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", "predicted")

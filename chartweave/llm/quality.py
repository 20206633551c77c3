"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. Spark sums count, values and
products for each class of the labelled rows; from them come class means and
covariances, shrunk towards their diagonal and towards the pooled covariance. Cholesky
factors of both are computed once; a score is the logistic function of the difference of
the Gaussian log densities (squared Mahalanobis distances and log determinants) plus the
log prior odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chartweave.llm.shared import identified, located, packed, write_through
from chartweave.llm.word_sets import buffers, slices, word_bounds, word_hashes

FEATURES = (
    "word_length upper sign bar other_ascii digit stop line_length repeat distinct short long"
).split()
#: Shares of the pooled covariance, then of the diagonal, in each class covariance.
POOLED, DIAGONAL, RIDGE = 0.1, 0.1, 1e-3

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[48:58] = 4
_CLASS[[33, 35, 36, 37, 38, 42, 64, 94, 126, 95, 61, 43]] = 5
_CLASS[[124, 60, 62, 91, 93, 123, 125, 92]] = 6
_CLASS[[46, 44, 59, 58, 63]] = 7
_CLASS[[34, 39, 40, 41, 45, 47, 96]] = 8
_CLASS[128:] = 9


#: Ordinary words that every text is taken to have besides its own, so that the shares of
#: a text of a few words lie near those of ordinary ones.
_PRIOR_WORDS, _PRIOR_CHARS, _PRIOR_STOPS = 8, 48, 1


def _one(part: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[float]:
    n, words = len(part) + _PRIOR_CHARS, len(begins) + _PRIOR_WORDS
    kinds = np.bincount(_CLASS[part], minlength=10)
    letters = kinds[2] + kinds[3] + kinds[9] + _PRIOR_CHARS
    size = ends - begins
    lines = 1 + int(np.count_nonzero(part == 10))
    repeat = np.count_nonzero(hashes[1:] == hashes[:-1])
    return [
        math.log((size.sum() + _PRIOR_CHARS) / words),
        math.sqrt(kinds[2] / letters),
        math.sqrt(kinds[5] / n),
        math.sqrt(kinds[6] / n),
        math.sqrt(kinds[8] / n),
        math.sqrt(kinds[4] / n),
        math.sqrt((kinds[7] + _PRIOR_STOPS) / n),
        math.log(words / lines),
        math.sqrt(repeat / words),
        # Distinct words against what a text of this length has by Heaps' law.
        (len(np.unique(hashes)) + _PRIOR_WORDS) / words**0.9,
        (np.count_nonzero(size <= 3) + _PRIOR_WORDS / 2) / words,
        np.count_nonzero(size >= 12) / words,
    ]


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of each text, whole; nulls count as empty texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    data, starts = buffers(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for first, last in slices(data, starts):
        part = data[starts[first] : starts[last]]
        local = starts[first : last + 1] - starts[first]
        begins, ends, counts = word_bounds(part, local)
        hashes = word_hashes(part, begins, ends)
        at = 0
        for i, n in enumerate(counts.tolist()):
            own = slice(at, at + n)
            out[first + i] = _one(part[local[i] : local[i + 1]], begins[own], ends[own], hashes[own])
            at += n
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c != "text"]
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], *[pa.array(x[:, j].copy()) for j in range(x.shape[1])]],
            names=[*keep, *FEATURES],
        )


class Discriminant:
    """Means and Cholesky factors of two classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        self.parts: dict = {}
        if len(moments) < 2:  # nothing to tell apart
            self.parts = dict.fromkeys(moments)
            return
        n = {c: m[0] for c, m in moments.items()}
        mean = {c: m[1] / m[0] for c, m in moments.items()}
        scatter = {c: m[2] - m[0] * np.outer(mean[c], mean[c]) for c, m in moments.items()}
        pooled = sum(scatter.values()) / max(1.0, sum(n.values()) - len(n))
        scale = np.diag(np.diag(pooled)) + RIDGE * np.eye(len(pooled))
        for c in moments:
            own = scatter[c] / max(1.0, n[c] - 1)
            own = (1 - POOLED) * own + POOLED * pooled
            own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + RIDGE * scale
            root = np.linalg.cholesky(own)
            self.parts[c] = (mean[c], np.linalg.inv(root), 2 * np.log(np.diag(root)).sum(), math.log(n[c]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1. With one class known it is that class; with none, a half."""
        if len(self.parts) < 2:
            return np.full(len(x), 0.5 if not self.parts else float(next(iter(self.parts))))
        log = {}
        for c, (mean, inverse, volume, weight) in self.parts.items():
            z = (x - mean) @ inverse.T
            log[c] = weight - 0.5 * ((z * z).sum(axis=1) + volume)
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def fit_discriminant(measured: DataFrame, label: str) -> Discriminant:
    """Moments of all rows whose label is 0 or 1, merged map-side; a few numbers reach the driver."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    rows = (
        measured.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("c"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(f) for f in FEATURES]).alias("s"),
            F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]).alias("p"),
        )
        .collect()
    )
    moments = {}
    for r in rows:
        product = np.zeros((len(FEATURES), len(FEATURES)))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            product[i, j] = product[j, i] = v
        moments[r["c"]] = (float(r["n"]), np.array(r["s"]), product)
    return Discriminant(moments)


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            keep = [c for c in batch.schema.names if c not in FEATURES]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(model.scores(x))], names=[*keep, "score"]
            )

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    learn: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: __file, __row, doc_id, score (0 to 1, higher: label 1 likelier).

    Labels (0 or 1; others and nulls are ignored) are met by id and used only where ``learn``,
    a condition on ``doc_id``, holds. An id with several labels counts with each different one. Null
    and empty texts are scored as texts without words. An empty table gives an empty result;
    without labels of both classes scores are constant.
    """
    docs = located(docs)
    rows = identified(docs).select(
        "__file", "__row", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].cast("string").alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    measured = write_through(
        rows.mapInArrow(
            _measured,
            f"__file bigint, __row bigint, doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES),
        ),
        "statistics",
    )
    known = packed(labels).select(
        F.col("row")[doc_id].alias("doc_id"), F.col("row")[label].alias("__label")
    ).distinct()
    taught = measured.join(known, "doc_id")
    model = fit_discriminant(taught if learn is None else taught.where(learn), "__label")
    return measured.mapInArrow(_scored(model), f"__file bigint, __row bigint, doc_id {kind}, score double")

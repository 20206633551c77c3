"""Language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed letter n-grams (one to three bytes of the lower-cased text, digits and
other ASCII signs taken as breaks), square-rooted and scaled to length one. A linear
softmax model tells families apart; inside a family each pair of languages has a
linear support vector machine, and the language with the most wins (then the larger
sum of margins) is predicted. All models are trained in Spark tasks, each on a bounded
sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chartweave.llm.shared import ROW_KEY, dropping, identified, located, packed, short_batches
from chartweave.llm.word_sets import buffers
from chartweave.operators.shared_storage import write_through

# Families of common language codes; a code that isn't here is its own family.
FAMILIES = {
    "germanic": "af da de en is nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
}
#: Hash buckets of n-grams.
WIDTH = 2048
#: Labelled rows a language that the models learn from, chosen by a hash of the text.
SAMPLE_ROWS = 600
#: Rows that the family model learns from at most, in equal shares of all languages.
FAMILY_ROWS = 6000
UNDETERMINED = "und"

_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_SALT = np.random.default_rng(11).integers(1, 2**32, 3, dtype=np.uint32) | np.uint32(1)
#: Texts are counted so many bytes at a time.
_PIECE = 1 << 18


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"own:{lang}")


def features(texts: pa.Array) -> np.ndarray:
    """One row of n-gram weights for each text of an array; nulls and empty texts give zeros."""
    if texts.null_count:
        texts = texts.fill_null("")
    data, starts = buffers(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i in range(len(texts)):
        counts = np.zeros(WIDTH, np.int64)
        for at in range(starts[i], starts[i + 1], _PIECE):
            b = _LETTER[data[at : min(at + _PIECE, starts[i + 1])]].astype(np.uint32)
            on = b > 0
            gram, use = b * _SALT[0], on
            for n in range(3):
                if n:
                    if len(b) <= n:
                        break
                    use = use[:-1] & on[n:]
                    gram = gram[:-1] * _SALT[1] + b[n:] * _SALT[2]
                counts += np.bincount((gram[use] * np.uint32(2654435761)) >> np.uint32(21), minlength=WIDTH)
        root = np.sqrt(counts, dtype=np.float32)
        norm = float(np.sqrt(np.dot(root, root)))
        out[i] = root / norm if norm else root
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, n: int, steps: int = 100) -> np.ndarray:
    """Weights (n, width + 1) of a multinomial logistic model, by accelerated gradient steps."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    weight = ahead = np.zeros((n, x.shape[1]), np.float32)
    goal = np.eye(n, dtype=np.float32)[y]
    for t in range(steps):
        slope = (_softmax(x @ ahead.T) - goal).T @ x / len(x) + np.float32(1e-5) * ahead
        new = ahead - np.float32(2) * slope
        ahead = new + np.float32(t / (t + 3)) * (new - weight)
        weight = new
    return weight


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (width + 1) of a linear SVM (squared hinge loss) for y in {-1, 1}; dual coordinate descent."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32))).astype(np.float64)
    weight, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    own = (x * x).sum(axis=1) + 0.5 / c
    order = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ weight) - 1 + 0.5 / c * alpha[i]
            new = max(0.0, alpha[i] - g / own[i])
            if new != alpha[i]:
                weight += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight


def _learned(group: pd.DataFrame) -> pd.DataFrame:
    """One model from the bounded sample of its task: 'family' or 'a|b'."""
    task = group["task"].iloc[0]
    group = group.sort_values(["rank", "lang"])
    x = np.stack(group["weights"].to_numpy()).astype(np.float32, copy=False)
    if task == "family":
        names = sorted({family_of(lang) for lang in group["lang"]})
        y = np.array([names.index(family_of(lang)) for lang in group["lang"]])
        weight = fit_softmax(x, y, len(names)) if len(names) > 1 else np.zeros((1, WIDTH + 1))
        return pd.DataFrame({"task": "family", "name": names, "weight": list(weight.astype(np.float32))})
    first = task.split("|")[0]
    weight = fit_svm(x, np.where(group["lang"] == first, 1.0, -1.0))
    return pd.DataFrame({"task": [task], "name": [first], "weight": [weight.astype(np.float32)]})


class LanguageModel:
    """Learned weights: a few vectors, whatever the size of the corpus."""

    def __init__(self, langs: list[str], rows: list) -> None:
        self.langs = sorted(langs)
        self.families = {r["name"]: np.asarray(r["weight"], np.float32) for r in rows if r["task"] == "family"}
        self.pairs = {tuple(r["task"].split("|")): np.asarray(r["weight"], np.float32) for r in rows if r["task"] != "family"}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        if not names:
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        weight = np.stack([self.families[f] for f in names])
        chance = _softmax((x @ weight[:, :-1].T + weight[:, -1]).astype(np.float64))
        chosen = chance.argmax(axis=1)
        lang, score = np.empty(len(x), object), chance.max(axis=1)
        for f, name in enumerate(names):
            rows = np.flatnonzero(chosen == f)
            own = [g for g in self.langs if family_of(g) == name]
            if len(own) == 1 or not len(rows):
                lang[rows] = own[0]
                continue
            wins, margins = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, j in combinations(range(len(own)), 2):
                w = self.pairs[own[i], own[j]]
                m = x[rows] @ w[:-1] + w[-1]
                wins[:, i] += m >= 0
                wins[:, j] += m < 0
                margins[:, i] += m
                margins[:, j] -= m
            best = np.lexsort((margins, wins), axis=1)[:, -1]
            lang[rows] = np.array(own, object)[best]
            score[rows] *= 1 / (1 + np.exp(-2 * margins[np.arange(len(rows)), best] / (len(own) - 1)))
        return list(lang), score


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features in place of texts: rows of one size, however long a text is."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            flat = features(part.column("text")).ravel()
            offsets = pa.array(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32))
            weights = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("rank"), weights], names=["lang", "rank", "weights"]
            )


def fit_language_model(docs: DataFrame, text: str, lang: str, usable: Column | None, rows_each: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``rows_each`` labelled rows of each language.

    Texts become features where they are read; the models' tasks get features only, so neither long
    texts nor many languages fill one. Equal texts of a language count once.
    """
    rows = packed(docs) if usable is None else packed(docs.where(usable))
    rows = rows.select(F.col("row")[lang].cast("string").alias("lang"), F.col("row")[text].cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("lang") != "")
    # Copies of a text share its hash, so shares are of different texts; a sketch will do to set them.
    texts = F.approx_count_distinct(F.xxhash64("text")).alias("n")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(texts).collect()}
    langs = sorted(counts)
    # Keep about twice the wanted share by hash before the exact choice, so that little is sorted.
    share = F.create_map(*[F.lit(v) for g in langs for v in (g, min(1.0, 2 * rows_each / max(1, counts[g])))]) if langs else F.lit(None)
    rank = F.abs(F.xxhash64("text")) / F.lit(float(2**63))
    few = rows.withColumn("rank", rank)
    if langs:
        few = few.where(F.col("rank") <= F.element_at(share, F.col("lang")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    sample = few.mapInArrow(_weights, "lang string, rank double, weights array<float>").dropDuplicates(["lang", "rank"])
    sample = sample.withColumn("place", first).where(F.col("place") <= rows_each)
    with short_batches(docs.sparkSession):
        sample = write_through(sample, "language-sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    by_family: dict[str, list[str]] = {}
    for g in langs:
        by_family.setdefault(family_of(g), []).append(g)
    tasks = [("family", g, -(-FAMILY_ROWS // len(langs))) for g in langs]
    for own in by_family.values():
        tasks += [(f"{a}|{b}", g, rows_each) for a, b in combinations(own, 2) for g in (a, b)]
    if not tasks:
        return LanguageModel([], [])
    plan = docs.sparkSession.createDataFrame(tasks, "task string, lang string, most int")
    models = (
        sample.join(F.broadcast(plan), "lang")
        .where(F.col("place") <= F.col("most"))
        .groupBy("task")
        .applyInPandas(_learned, "task string, name string, weight array<float>")
    )
    return LanguageModel(langs, models.collect())


def _predictions(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "text"]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score = model.predict(features(part.column("text")))
                lettered = part.column("lettered").to_pylist()
                lang = [g if ok else UNDETERMINED for g, ok in zip(lang, lettered, strict=True)]
                score = [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )

    return run


def identify_languages(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    usable: Column | None = None,
    rows_each: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: __file, __row, doc_id, lang_pred, score (0 to 1).

    lang_pred is a language of the labelled rows that meet ``usable`` (all, if None), or
    ``und`` with score 0 if the text is null, has no letter, or nothing could be learned.
    Whole texts are read; ids, labels and other columns don't influence a prediction. Equal chances
    of families go to the first by name, equal wins and margins to the last. An empty table gives an empty result.
    """
    return _identified(docs, text, lang, doc_id, usable, rows_each).drop("lettered")


def _identified(
    docs: DataFrame, text: str, lang: str, doc_id: str, usable: Column | None = None, rows_each: int = SAMPLE_ROWS
) -> DataFrame:
    """The result of ``identify_languages``, and as ``lettered`` whether a text has a letter."""
    docs = located(docs)
    model = fit_language_model(docs, text, lang, usable, rows_each)
    rows = identified(docs).select(
        "__file",
        "__row",
        F.col("row")[doc_id].alias("doc_id"),
        F.col("row")[text].cast("string").alias("text"),
        F.coalesce(F.col("row")[text].cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        _predictions(model),
        f"__file bigint, __row bigint, doc_id {kind}, lettered boolean, lang_pred string, score double",
    )


def drop_undetermined(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose language is undetermined as they have no letter; same columns.

    If no language could be learned, nothing else is dropped either.
    """
    docs = located(docs)
    found = _identified(docs, text, lang, doc_id)
    dropped = found.where((F.col("lang_pred") == UNDETERMINED) & ~F.col("lettered")).select("__file", "__row")
    return dropping(identified(docs), dropped, ROW_KEY).select("row.*")

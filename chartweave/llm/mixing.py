"""Mixing to target weights by soft membership.

A classifier learned from the labelled table gives each document the posteriors of the
domains. Nonnegative rates of documents are fitted by projected-gradient least squares,
so that the expected tokens of each domain (rate * tokens * posterior, summed) meet the
targets. Everything is DataFrame functions.

The classifier is naive Bayes over a few binned statistics and the presence of telling
words, so documents share a bounded number of posterior vectors. In the metric that
weights a document by its tokens, a gradient step moves documents with one posterior
vector alike; steps therefore run on sums of tokens over equal vectors, without loss.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from chartweave.llm.packing import word_count
from chartweave.llm.shared import ROW_KEY, dropping, identified, located, packed, write_through

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}
#: About so many labelled documents teach the classifier, chosen by a hash of the text.
LABELLED_ROWS = 10_000
#: Telling words of each domain.
TELLING = 24
STEPS = 40

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "!#$%&*|@^~<>{}"
#: Bin borders of the shares of upper-case letters, signs and distinct words.
_BORDERS = ((0.005, 0.02, 0.05, 0.1, 0.3), (0.002, 0.01, 0.03, 0.1), (0.15, 0.3, 0.45, 0.6, 0.8))
_HITS = (1, 2, 4)


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document; null without usable labels."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def _binned(value: Column, borders: tuple) -> Column:
    out = F.lit(0)
    for i, border in enumerate(borders):
        out = F.when(value >= border, F.lit(i + 1)).otherwise(out)
    return out


def _bins(rows: DataFrame, telling: dict[str, list[str]]) -> DataFrame:
    """Replaces ``text`` by its words and by one bin number for each feature."""
    text = F.col("text")
    size = F.greatest(F.length(text), F.lit(1))

    def share(signs: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, signs, ""))) / size

    shares = rows.withColumns({"__words": _words(text), "__upper": share(_UPPER), "__signs": share(_SIGNS)})
    words, distinct, told = F.col("__words"), F.col("__distinct"), F.col("__told")
    every = sorted({w for d in DOMAINS for w in telling.get(d) or []})
    # The words of a text are gone through once for each column; what follows sees a few of them.
    shares = shares.withColumn("__distinct", F.array_distinct(words))
    known = F.array(*map(F.lit, every)) if every else F.array().cast("array<string>")
    shares = shares.withColumn("__told", F.array_intersect(distinct, known))
    values = [
        _binned(F.col("__upper"), _BORDERS[0]),
        _binned(F.col("__signs"), _BORDERS[1]),
        # Few words tell nothing about repetition.
        F.when(F.size(words) < 20, F.lit(len(_BORDERS[2]))).otherwise(
            _binned(F.size(distinct) / F.size(words), _BORDERS[2])
        ),
    ]
    for domain in DOMAINS:
        own = telling.get(domain) or []
        hit = F.size(F.array_intersect(told, F.array(*map(F.lit, own)))) if own else F.lit(0)
        values.append(_binned(hit, _HITS))
    return shares.withColumns({f"__b{i}": v.cast("int") for i, v in enumerate(values)}).drop(
        "text", "__words", "__distinct", "__told", "__upper", "__signs"
    )


_FEATURES = [f"__b{i}" for i in range(3 + len(DOMAINS))]
_BIN_COUNTS = [len(b) + 1 for b in _BORDERS] + [len(_HITS) + 1] * len(DOMAINS)


def fit_classifier(taught: DataFrame) -> tuple[dict[str, list[str]], dict]:
    """Telling words and counts of bins from (text, domain); a few hundred numbers reach the driver."""
    totals = {r["domain"]: r["n"] for r in taught.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(totals.values())
    telling: dict[str, list[str]] = {}
    if every:
        seen = (
            taught.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
            .where(F.length("word") > 2)
            .groupBy("word")
            .agg(
                F.count(F.lit(1)).alias("all"),
                *[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS],
            )
        )
        seen = write_through(seen, "telling")
        for d in DOMAINS:
            own, rest = totals.get(d, 0), every - totals.get(d, 0)
            odds = F.log((F.col(d) + 0.5) / (own + 1)) - F.log((F.col("all") - F.col(d) + 0.5) / (rest + 1))
            top = seen.select("word", (F.col(d) * odds).alias("worth"), odds.alias("odds"))
            best = top.where("odds > 1").orderBy(F.desc("worth"), "word").limit(TELLING).collect()
            telling[d] = [r["word"] for r in best]
    binned = _bins(taught, telling)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("b")) for i, c in enumerate(_FEATURES)]))
    counts = {
        (r["domain"], r["f"], r["b"]): r["n"]
        for r in binned.select("domain", pairs.alias("x")).groupBy("domain", "x.f", "x.b").agg(
            F.count(F.lit(1)).alias("n")
        ).collect()
    }
    return telling, {"totals": totals, "counts": counts}


def posteriors(rows: DataFrame, telling: dict[str, list[str]], model: dict) -> DataFrame:
    """Adds one column for each domain, rounded so that equal features give equal vectors."""
    totals, counts = model["totals"], model["counts"]
    every, logs = sum(totals.values()), []
    for d in DOMAINS:
        own = totals.get(d, 0)
        log = F.lit(math.log((own + 1) / (every + len(DOMAINS))))
        for i, column in enumerate(_FEATURES):
            table = [math.log((counts.get((d, i, b), 0) + 0.5) / (own + 0.5 * _BIN_COUNTS[i])) for b in range(_BIN_COUNTS[i])]
            log = log + F.array(*map(F.lit, table))[F.col(column)]
        logs.append(log)
    named = rows.withColumns({f"__l_{d}": log for d, log in zip(DOMAINS, logs, strict=True)})
    top = F.greatest(*[F.col(f"__l_{d}") for d in DOMAINS])
    named = named.withColumns({f"__e_{d}": F.exp(F.col(f"__l_{d}") - top) for d in DOMAINS})
    whole = sum((F.col(f"__e_{d}") for d in DOMAINS[1:]), F.col(f"__e_{DOMAINS[0]}"))
    return named.withColumns({f"p_{d}": F.round(F.col(f"__e_{d}") / whole, 6) for d in DOMAINS}).drop(
        *[f"__l_{d}" for d in DOMAINS], *[f"__e_{d}" for d in DOMAINS], *_FEATURES
    )


def _rate(slopes: list[tuple[np.ndarray, float]], step: float, most: float) -> tuple[Column, Column]:
    """The rate of a row after these accelerated steps, and the point where the next slope is taken."""
    if not slopes:
        return F.lit(1.0), F.lit(1.0)
    # One literal, however many steps: plans stay small and their code is compiled once.
    history = F.from_json(F.lit(json.dumps([[*map(float, g), b] for g, b in slopes])), "array<array<double>>")
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))

    def move(state: Column, g: Column) -> Column:
        slope = sum((F.col(f"p_{d}") * g[i] for i, d in enumerate(DOMAINS[1:], 1)), F.col(f"p_{DOMAINS[0]}") * g[0])
        new = F.greatest(F.lit(0.0), F.least(F.lit(most), state["ahead"] - F.lit(step) * slope))
        return F.struct(new.alias("rate"), (new + g[len(DOMAINS)] * (new - state["rate"])).alias("ahead"))

    end = F.aggregate(history, start, move)
    return end["rate"], end["ahead"]


def fit_rates(sums: DataFrame, targets: np.ndarray, most: float, steps: int = STEPS) -> tuple[Column, np.ndarray]:
    """Rate as an expression over the posteriors, and the domain shares that it gives.

    ``sums`` has the posteriors and ``tokens``; targets are shares of all tokens. Each step
    is one aggregation in Spark that returns a number for each domain.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    first = sums.agg(
        F.sum("tokens").alias("all"),
        *[F.sum(F.col("tokens") * a * b).alias(f"m{i}_{j}") for i, a in enumerate(p) for j, b in enumerate(p)],
    ).first()
    every = float(first["all"] or 0)
    if not every:
        return F.lit(1.0), np.zeros(len(p))
    gram = np.array([[first[f"m{i}_{j}"] for j in range(len(p))] for i in range(len(p))]) / every
    step = 1 / max(1e-9, float(np.linalg.eigvalsh(gram)[-1]))
    slopes: list[tuple[np.ndarray, float]] = []
    for t in range(steps):
        _, ahead = _rate(slopes, step, most)
        at = sums.withColumn("__at", ahead)
        row = at.agg(*[F.sum(F.col("tokens") * F.col("__at") * q) for q in p]).first()
        slope = np.array([float(v) for v in row]) / every - targets
        slopes.append((slope, t / (t + 3)))
        if np.abs(slope).max() < 1e-4 or (t > 5 and np.abs(slope - slopes[-2][0]).max() < 1e-5):
            break
    rate, _ = _rate(slopes, step, most)
    row = sums.withColumn("__at", rate).agg(*[F.sum(F.col("tokens") * F.col("__at") * q) for q in p]).first()
    return rate, np.array([float(v) for v in row]) / every


def mixed_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    most: float = 4.0,
    keep: str | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """__file, __row, doc_id, n_tokens, p_good, p_low, p_toxic, rate, copies for each row of ``docs``.

    Rates lie in [0, most]. Targets are shares of the tokens that come out; those come to
    as many as go in, or, with ``keep``, to what leaves that domain's documents whole. ``copies``
    is the rate rounded up or down by a hash of the row, so that sums are met in expectation.
    Null texts count as empty and have no tokens; labels that are null or neither 0 nor
    1 are ignored; without labels posteriors are even. An empty table gives an empty result.
    """
    targets = targets or TARGETS
    docs = located(docs)
    rows = identified(docs).select(
        *ROW_KEY,
        F.col("row")[doc_id].alias("doc_id"),
        F.coalesce(F.col("row")[text].cast("string"), F.lit("")).alias("text"),
    )
    known = (
        packed(labels)
        .select(F.col("row")[doc_id].alias("doc_id"), domain_of(F.col("row")["quality"], F.col("row")["toxic"]).alias("domain"))
        .where("domain IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
    )
    # Labels are thinned before they meet texts, so that no more than the sample is shuffled.
    n = known.count()
    part = F.abs(F.xxhash64("doc_id")) / F.lit(float(2**63))
    chosen = write_through(known.where(part <= min(1.0, LABELLED_ROWS / max(1, n))), "labelled")
    taught = write_through(
        rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "domain"), "taught"
    )
    telling, model = fit_classifier(taught)
    scored = write_through(
        posteriors(
            _bins(
                rows.withColumns({"n_tokens": word_count(F.col("text")), "u": F.xxhash64("doc_id", "text")}), telling
            ),
            telling,
            model,
        ),
        "posteriors",
    )
    names = [f"p_{d}" for d in DOMAINS]
    sums = scored.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    sums = write_through(sums.coalesce(1), "posterior-sums")  # bounded by the numbers of bins
    goal = np.array([targets[d] for d in DOMAINS], float)
    goal = goal / goal.sum()
    if keep:
        row = sums.agg(F.sum(F.col("tokens") * F.col(f"p_{keep}")), F.sum("tokens")).first()
        goal = goal * (float(row[0] or 0) / max(1.0, float(row[1] or 0)) / targets[keep] * sum(targets.values()))
    rate, _ = fit_rates(sums, goal, most)
    return scored.withColumn("rate", rate).select(
        *ROW_KEY,
        "doc_id",
        "n_tokens",
        *names,
        "rate",
        (F.floor("rate") + F.when(F.pmod("u", F.lit(1_000_003)) / 1_000_003 < F.col("rate") - F.floor("rate"), 1).otherwise(0))
        .cast("int")
        .alias("copies"),
    )


def mix(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` thinned towards the targets, good documents kept whole; same columns, no row twice."""
    docs = located(docs)
    found = mixed_rates(docs, labels, most=1.0, keep="good", text=text, doc_id=doc_id)
    return dropping(identified(docs), found.where("copies = 0"), ROW_KEY).select("row.*")

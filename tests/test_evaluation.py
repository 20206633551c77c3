"""Running totals, metrics, resampling, splits and folds against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartweave.functions import hashes
from chartweave.operators import metrics, running, splits

SCHEMA = "stay long, patient string, site int, label int, score double, part string"


def invented(seed: int, count: int):
    """Predictions with tied, null and NaN scores, unknown labels; one patient has a third of all."""
    dice = random.Random(seed)
    rows = []
    for stay in range(count):
        patient = "hot" if dice.random() < 0.33 else dice.choice([None, *[f"p{i}" for i in range(count // 4)]])
        score = dice.choice([None, float("nan"), 0.0, -0.0, float("inf"), *[dice.randrange(40) / 8 for _ in range(20)]])
        rows.append((stay, patient, dice.choice([1, 1, 2, 3, 4, 5, 6, 7, None]), dice.choice([0, 0, 1, None, 2]), score, "x"))
    return rows


def usable(rows):
    return [(r[4], r[3]) for r in rows if r[3] in (0, 1) and r[4] is not None and not math.isnan(r[4])]


def brute_auroc(pairs):
    ups = [s for s, label in pairs if label == 1]
    downs = [s for s, label in pairs if label == 0]
    if not ups or not downs:
        return None
    return sum(2 * (u > d) + (u == d) for u in ups for d in downs) / (2 * len(ups) * len(downs))


def brute_precision(pairs):
    positives = sum(label for _, label in pairs)
    if not positives or positives == len(pairs):
        return None
    total, last = 0.0, 0
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        shown = [label for s, label in pairs if s >= cut]
        total += (sum(shown) - last) / positives * sum(shown) / len(shown)
        last = sum(shown)
    return total


@pytest.fixture(params=[10**6, 7])
def ranges(request, monkeypatch):
    """All rows in one range, and in many."""
    monkeypatch.setattr(running, "RANGE_ROWS", request.param)
    monkeypatch.setattr(running, "MAX_BROADCAST_RANGES", 3 if request.param == 7 else 10)


def test_running_totals(spark, ranges):
    dice = random.Random(2)
    rows = [(dice.choice(["a", "a", "b", None]), i, dice.choice([None, 0, 1, 5])) for i in range(60)]
    frame = spark.createDataFrame(rows, "g string, i int, v long").repartition(3)
    found = running.running_totals(frame, ["g"], [F.col("i").desc()], ["v"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.v_before == sum(v or 0 for g, i, v in rows if g == r.g and i > r.i)
    ids = running.dense_ids(frame.select("i"), [F.col("i")], "id").collect()
    assert sorted((r.i, r.id) for r in ids) == [(i, i) for i in range(60)]


def test_ranking(spark, ranges):
    rows = invented(1, 300)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for r in metrics.ranking_metrics(frame, by=["site"]).collect():
        own = [x for x in rows if x[2] == r.site]
        pairs = usable(own)
        assert (r.positives + r.negatives, r.unusable) == (len(pairs), len(own) - len(pairs))
        assert r.auroc == brute_auroc(pairs)
        assert r.average_precision == pytest.approx(brute_precision(pairs), abs=1e-12)
    whole = metrics.ranking_metrics(frame).first()
    assert whole.auroc == brute_auroc(usable(rows))


def test_one_class_is_a_note(spark):
    rows = [(1, "p", 1, 1, 0.5, "x"), (2, "p", 1, 1, 0.2, "x"), (3, "p", 2, None, 0.1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = metrics.ranking_metrics(frame, by=["site"]).orderBy("site").collect()
    assert [(r.auroc, r.average_precision, r.note) for r in found] == [(None, None, "one class")] * 2
    empty = metrics.ranking_metrics(frame.where("false")).first()
    assert (empty.positives, empty.negatives, empty.unusable, empty.note) == (0, 0, 0, "one class")


def test_thresholds(spark, ranges):
    rows = invented(4, 200)
    frame = spark.createDataFrame(rows, SCHEMA)

    def f1(pairs, cut):
        tp = sum(label for s, label in pairs if s >= cut)
        wrong = sum((s >= cut) != bool(label) for s, label in pairs)
        return 2 * tp / (2 * tp + wrong) if tp or wrong else None

    best = {r.site: (r.threshold, r.f1) for r in metrics.best_f1_threshold(frame, by=["site"]).collect()}
    at = {r.site: r for r in metrics.threshold_metrics(frame, 2.5, by=["site"]).collect()}
    for site in {r[2] for r in rows}:
        pairs = usable([r for r in rows if r[2] == site])
        top = max((f1(pairs, s), s) for s, _ in pairs)
        assert best[site] == (top[1], top[0])
        assert at[site].f1 == f1(pairs, 2.5)
        sides = [[s >= 2.5 for s, label in pairs if label == side] for side in (0, 1)]
        if all(sides):
            share = (sum(sides[1]) / len(sides[1]) + 1 - sum(sides[0]) / len(sides[0])) / 2
            assert at[site].balanced_accuracy == pytest.approx(share)
    weights = metrics.positive_weight(frame.where("label = 0")).first()
    assert (weights.positives, weights.weight) == (0, None)


def brute_draws(patients, replicates, seed):
    for r in range(replicates):
        hashes = [hashlib.md5(f"{seed}:{r}:{d}".encode()).hexdigest() for d in range(len(patients))]
        yield Counter(patients[int(h[:15], 16) % len(patients)] for h in hashes)


def test_bootstrap_replays_its_draws(spark, ranges):
    rows = invented(9, 60)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    patients = sorted({r[1] for r in rows if r[1]})
    wanted = {}
    for replicate, times in enumerate(brute_draws(patients, 40, 7)):
        pairs = usable([r for r in rows if r[1] for _ in range(times[r[1]])])
        wanted[replicate] = (brute_auroc(pairs), brute_precision(pairs))
    found = metrics.resampled_metrics(frame, "patient", replicates=40, seed=7).collect()
    assert {r.replicate: r.auroc for r in found} == {k: v[0] for k, v in wanted.items()}
    for metric, at in (("auroc", 0), ("average_precision", 1)):
        values = sorted(v[at] for v in wanted.values() if v[at] is not None)
        row = metrics.bootstrap_intervals(frame, "patient", replicates=40, seed=7).where(F.col("metric") == metric).first()
        assert (row.used, row.skipped) == (len(values), 40 - len(values))
        assert row.low == pytest.approx(values[max(1, math.ceil(len(values) * 0.025)) - 1])
        assert row.high == pytest.approx(values[math.ceil(len(values) * 0.975) - 1])


def test_draws_move_once(spark):
    times = metrics.drawn_times(spark, 30, 50)
    rows = [tuple(row) for row in times.collect()]
    assert len({row[:2] for row in rows}) == len(rows) and {row[0] for row in rows} <= set(range(50))
    assert all(sum(n for _, r, n in rows if r == replicate) == 50 for replicate in range(30))
    plan = times.groupBy("number").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bootstrap_counts_replicates_of_one_class(spark):
    rows = [(1, "a", 1, 1, 0.5, "x"), (2, "b", 1, 0, 0.2, "x")]
    found = metrics.bootstrap_intervals(spark.createDataFrame(rows, SCHEMA), "patient", replicates=30).collect()
    one = sum(len(times) == 1 for times in brute_draws(["a", "b"], 30, 42))
    assert one and {(r.used, r.skipped, r.low) for r in found} == {(30 - one, one, 1.0)}
    none = spark.createDataFrame(rows, SCHEMA).where("false")
    assert metrics.bootstrap_intervals(none, "patient").collect() == []


def test_hashes_of_numbers(monkeypatch):
    for prefix in (b"", b"4", b"42:7:", b"-42:17:", b"42:177:", b"42:1776:", b"x" * 48, b"x" * 52):
        for start, stop in ((0, 1), (0, 130), (5, 5), (95, 1234), (99_990, 100_020), (1_234_567, 1_234_600), (10**11 - 1, 10**11 + 5)):
            wanted = [int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:15], 16) for i in range(start, stop)]
            for texts in (20_000, 33):
                monkeypatch.setattr(hashes, "BLOCK_TEXTS", texts)
                assert [n for found in hashes.md5_numbers(prefix, start, stop) for n in found.tolist()] == wanted


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of five patients, several units of draws a replicate, short batches."""
    for name, value in (("TABLE_BYTES", 200), ("COUNTED_DRAWS", 7), ("TASK_DRAWS", 50), ("BATCH_BYTES", 10), ("ADDED_ROWS", 2)):
        monkeypatch.setattr(metrics, name, value)


def test_bootstrap_in_blocks(spark, small_blocks):
    rows = invented(9, 80)
    rows += [(100 + i, "p1", 1, 1, 0.5, "x") for i in range(9)]  # one score several times
    patients = sorted({r[1] for r in rows if r[1]})
    wanted = {}
    for replicate, times in enumerate(brute_draws(patients, 40, 7)):
        own = [r for r in rows if r[1] for _ in range(times[r[1]])]
        pairs = usable(own)
        positives = sum(label for _, label in pairs)
        wanted[replicate] = (positives, len(pairs) - positives, len(own) - len(pairs), brute_auroc(pairs))
    found = metrics.resampled_metrics(spark.createDataFrame(rows, SCHEMA).repartition(4), "patient", replicates=40, seed=7).collect()
    assert {r.replicate: (r.positives, r.negatives, r.unusable, r.auroc) for r in found} == wanted
    drawn = {(r.replicate, patients[r.number]): r.times for r in metrics.drawn_times(spark, 40, len(patients), 7).collect()}
    assert drawn == {(i, p): n for i, times in enumerate(brute_draws(patients, 40, 7)) for p, n in times.items()}


def test_bootstrap_adds_rows_before_they_leave_a_block(spark, monkeypatch):
    rows = [(i, f"p{i}", 1, i % 2, 0.5, "x") for i in range(200)]
    ranked, met = metrics.ranking_metrics, []

    def ranking(frame, *given):
        met.append(frame.count())
        return ranked(frame, *given)

    monkeypatch.setattr(metrics, "ranking_metrics", ranking)
    assert metrics.resampled_metrics(spark.createDataFrame(rows, SCHEMA), "patient", replicates=20).count() == 20
    assert met == [40]  # two labels of one score in each replicate, not each patient's row


def test_counts_of_draws_have_the_width_they_need():
    schema = pa.schema(
        [("block", pa.int64()), ("replicate", pa.int32()), ("counts", pa.binary()), ("member", pa.int64())]
        + [("score", pa.float64()), ("label", pa.int32()), ("rows", pa.int64())]
    )
    rows = [(3, 0, bytes([1, 200])), (3, 0, bytes([0, 100])), (3, 1, np.array([0, 70_000], np.uint32).tobytes())]
    rows = [(*r, None, None, None, None) for r in rows]
    rows += [(3, None, None, 0, None, None, 5), (3, None, None, 0, 0.5, 0, 1), (3, None, None, 1, 0.5, 0, 2)]
    rows += [(4, 1, bytes([1, 2]), None, None, None, None), (4, None, None, 1, 0.5, 0, 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 5]], schema) for i in (0, 5)]
    found = [r for batch in metrics._drawn_rows(2, 2)(iter(batches)) for r in batch.to_pylist()]
    totals = [(r["score"], r["label"], metrics._unpacked(r["counts"], 2).tolist()) for r in found]
    assert totals == [(None, None, [5, 0]), (0.5, 0, [1, 0]), (0.5, 0, [600, 140_000]), (0.5, 0, [0, 2])]
    spread = [tuple(r.values()) for b in metrics._added_rows(2)(iter([pa.RecordBatch.from_pylist(found)])) for r in b.to_pylist()]
    assert spread == [(0, None, None, 5), (0, 0.5, 0, 601), (1, 0.5, 0, 140_002)]


def brute_split(rows, seed):
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[r[1]].append(r[3])
    strata = defaultdict(list)
    for patient, labels in groups.items():
        known = [label for label in labels if label is not None]
        rank = hashlib.md5(f"{seed}:{patient}".encode()).hexdigest()
        strata[max(known) if known else None].append((rank, patient, len(labels)))
    parts = {None: None}
    for members in strata.values():
        total, before = sum(m[2] for m in members), 0
        for _, patient, n in sorted(members):
            middle = (2 * before + n) / (2 * total)
            parts[patient] = "train" if middle < 0.7 else "validation" if middle < 0.85 else "test"
            before += n
    return parts


def test_split(spark, ranges):
    rows = invented(3, 400)
    frame = spark.createDataFrame(rows, SCHEMA).drop("part")
    parts = brute_split(rows, 42)
    for partitions in (1, 6):
        found = splits.group_split(frame.repartition(partitions), "patient").collect()
        assert sorted((r.stay, r.part) for r in found) == [(r[0], parts[r[1]]) for r in rows]


def test_split_is_whole_and_balanced(spark):
    dice = random.Random(8)
    rows = [(i, f"p{dice.randrange(700)}", 1, int(dice.random() < 0.15), 0.5, "x") for i in range(2000)]
    split = splits.group_split(spark.createDataFrame(rows, SCHEMA).drop("part"), "patient")
    assert splits.split_violations(split, "stay", "patient").collect() == []
    shares = {r.part: (r.n / 2000, r.p) for r in split.groupBy("part").agg(F.count("*").alias("n"), F.avg("label").alias("p")).collect()}
    for (part, percent) in splits.PARTS:
        assert abs(shares[part][0] - percent / 100) < 0.01 and abs(shares[part][1] - 0.15) < 0.04


def test_split_violations(spark):
    rows = [
        (1, "a", 1, 0, 0.0, "train"), (2, "a", 1, 1, 0.0, "test"), (3, "b", 1, 1, 0.0, None),
        (4, "c", 1, 1, 0.0, "train"), (4, "c", 1, 1, 0.0, "train"), (5, "d", 1, 0, 0.0, "validation"),
        (6, "e", 1, 1, 0.0, "validation"), (6, "f", 1, 1, 0.0, "test"),
    ]
    found = splits.split_violations(spark.createDataFrame(rows, SCHEMA), "stay", "patient").collect()
    assert sorted(map(tuple, found)) == [
        ("class_missing", "test 0"), ("group_in_two_parts", "a"), ("stay_in_two_parts", "6"),
        ("stay_twice", "4"), ("stay_without_part", "3"),
    ]


def test_folds(spark, monkeypatch):
    rows = invented(6, 500)
    dice = random.Random(6)
    rows = [(*r[:2], dice.choice([None, *range(40)]), *r[3:]) for r in rows]
    frame = spark.createDataFrame(rows, SCHEMA)
    sites = defaultdict(lambda: [0, 0])
    for r in rows:
        if r[2] is not None:
            sites[r[2]][0] += 1
            sites[r[2]][1] += r[3] == 1
    total, positives = (sum(s[i] for s in sites.values()) for i in (0, 1))
    loads, folds = [[0, 0] for _ in range(5)], {None: None}
    for site, (n, p) in sorted(sites.items(), key=lambda s: (-s[1][0], s[0])):
        fold = min(range(5), key=lambda f: (loads[f][0] * positives + loads[f][1] * total, f))
        folds[site] = fold
        loads[fold][0] += n
        loads[fold][1] += p
    found = splits.group_folds(frame, "site").collect()
    assert sorted((r.stay, r.fold) for r in found) == [(r[0], folds[r[2]]) for r in rows]
    assert max(n for n, _ in loads) - min(n for n, _ in loads) < 0.1 * total
    assert splits.group_folds(frame.where("false"), "site").collect() == []
    monkeypatch.setattr(splits, "MAX_FOLD_GROUPS", 10)
    with pytest.raises(ValueError, match="sites"):
        splits.group_folds(frame, "site")

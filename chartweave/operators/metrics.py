"""Metrics of binary predictions: ranking, thresholds and resampled intervals.

Everything is integer sums over the counts of each distinct score, so a result is the same for
any partitioning. Scores are ordered across range partitions; no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.functions.hashes import md5_numbers
from chartweave.operators.running import dense_ids, running_totals
from chartweave.operators.shared_storage import write_through

#: Precision at one score is kept as this many parts of 1, rounded down.
PRECISION_PARTS = 10**15
REPLICATES, SEED = 1000, 42
INTERVAL = (0.025, 0.975)
ONE_CLASS = "one class"
#: Draws of one replicate that are counted at once, and draws of a task, about.
COUNTED_DRAWS, TASK_DRAWS = 1 << 23, 1 << 25
#: Counts of draws that a task holds as a table of replicates and groups, and bytes of a batch of them.
TABLE_BYTES, BATCH_BYTES = 1 << 25, 1 << 22
#: Rows of one score whose draws are added at once.
ADDED_ROWS = 4096


def _wide(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def _usable(score: str, label: str) -> Column:
    known = F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return F.coalesce(known, F.lit(False))


def score_counts(
    predictions: DataFrame, score: str, label: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*by, score, positives, negatives, unusable)``: one row per distinct score of a group.

    Rows whose label isn't 0 or 1, or whose score is null or NaN, are unusable. They are counted in
    a row with a null score. 0.0 and -0.0 are one score. ``weight`` counts a row several times.
    """
    times = F.col(weight) if weight else F.lit(1)
    usable = _usable(score, label)

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, times)), F.lit(0)).cast("bigint")

    number = F.when(usable, F.col(score).cast("double") + F.lit(0.0))
    rows = predictions.select(
        *by, number.alias("score"), F.col(label).alias("label"), usable.alias("usable"), times.alias("times")
    )
    times = F.col("times")
    return rows.groupBy(*by, "score").agg(
        count(F.col("usable") & (F.col("label") == 1)).alias("positives"),
        count(F.col("usable") & (F.col("label") == 0)).alias("negatives"),
        count(~F.col("usable")).alias("unusable"),
    )


def _above(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts with those of all higher scores of the group."""
    return running_totals(counts, by, [F.col("score").desc()], ["positives", "negatives"])


def ranking_metrics(
    predictions: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """``(*by, positives, negatives, unusable, auroc, average_precision, note)`` of each group.

    AUROC is the share of (positive, negative) pairs in the right order, ties counting half.
    Average precision is the step sum of precision over rising recall, all rows of one score at once.
    A group without both classes has neither, and its note says so. Null groups are groups; without
    ``by`` an empty table gives one row of zeros.
    """
    rows = _above(score_counts(predictions, score, label, by, weight), by)
    higher = _wide("positives_before") + _wide("positives")
    shown = higher + _wide("negatives_before") + _wide("negatives")
    # Twice the pairs in order plus the tied ones.
    ordered = _wide("negatives") * (2 * _wide("positives_before") + _wide("positives"))
    rows = rows.select(
        *by, "positives", "negatives", "unusable", ordered.alias("ordered"), higher.alias("higher"), shown.alias("shown")
    )
    precision = F.expr(f"CAST((higher * CAST({PRECISION_PARTS} AS DECIMAL(16, 0))) div nullif(shown, 0) AS BIGINT)")
    sums = rows.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("positives", "negatives", "unusable")],
        F.sum("ordered").cast("double").alias("ordered"),
        F.sum(_wide("positives") * _wide(F.coalesce(precision, F.lit(0)))).cast("double").alias("steps"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    positives, negatives = (F.col(c).cast("double") for c in ("positives", "negatives"))
    return sums.select(
        *by,
        "positives",
        "negatives",
        "unusable",
        F.when(both, F.col("ordered") / (2 * positives * negatives)).alias("auroc"),
        F.when(both, F.col("steps") / (float(PRECISION_PARTS) * positives)).alias("average_precision"),
        F.when(~both, F.lit(ONE_CLASS)).alias("note"),
    )


def _f1(tp: Column, fp: Column, positives: Column) -> Column:
    return 2 * tp.cast("double") / F.nullif((tp + fp + positives).cast("double"), F.lit(0.0))


def threshold_metrics(
    predictions: DataFrame,
    threshold: Column | float,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """``(*by, tp, fp, fn, tn, f1, balanced_accuracy)``; a score at the threshold counts as positive.

    Unusable rows (see ``score_counts``) don't count. Balanced accuracy is null without both classes,
    F1 without a positive and without a predicted one.
    """
    predicted = F.col(score).cast("double") >= threshold
    usable = _usable(score, label)

    def count(truth: int, said: Column) -> Column:
        return F.count_if(usable & (F.col(label) == truth) & said)

    counts = predictions.groupBy(*by).agg(
        count(1, predicted).alias("tp"),
        count(0, predicted).alias("fp"),
        count(1, ~predicted).alias("fn"),
        count(0, ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(part: Column, whole: Column) -> Column:
        return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))

    return counts.select(
        "*", _f1(tp, fp, tp + fn).alias("f1"), ((share(tp, tp + fn) + share(tn, tn + fp)) / 2).alias("balanced_accuracy")
    )


def best_f1_threshold(
    predictions: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, threshold, f1)``: the score that, taken as threshold, gives the highest F1.

    Of equal ones the highest score. Groups without a positive have no row.
    """
    counts = score_counts(predictions, score, label, by)
    totals = counts.groupBy(*by).agg(F.sum("positives").alias("all_positives")).where("all_positives > 0")
    rows = _above(counts, by).where("score IS NOT NULL")
    same = [rows[c].eqNullSafe(totals[c]) for c in by] or [F.lit(True)]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    tp = F.col("positives_before") + F.col("positives")
    fp = F.col("negatives_before") + F.col("negatives")
    f1 = _f1(tp, fp, F.col("all_positives"))
    joined = rows.join(totals, condition).select(*[rows[c] for c in by], F.struct(f1.alias("f1"), "score").alias("best"))
    best = joined.groupBy(*by).agg(F.max("best").alias("best"))
    return best.select(*by, F.col("best.score").alias("threshold"), F.col("best.f1").alias("f1")).where("f1 IS NOT NULL")


def positive_weight(labels: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, positives, negatives, weight)``: negatives per positive; null without a positive."""
    counts = labels.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )
    weight = F.col("negatives").cast("double") / F.nullif(F.col("positives").cast("double"), F.lit(0.0))
    return counts.withColumn("weight", weight)


def _counted_draws(seed: int, groups: int, block: int):
    """Arrow batches of unit ids to (block, replicate, counts): how often a unit draws each number of a block.

    A unit is ``COUNTED_DRAWS`` draws of one replicate. A draw is a hash of seed, replicate and its place, so any
    task repeats it: the first 15 digits of the MD5 text, modulo the groups. Counts are as narrow as the highest asks.
    """
    at_once = COUNTED_DRAWS
    units = -(-groups // at_once)
    starts = np.arange(-(-groups // block) + 1, dtype=np.uint64) * np.uint64(block)
    width = np.uint32 if int(starts[-1]) < 2**32 else np.uint64
    starts = starts.astype(width)

    def counted(replicate: int, unit: int) -> Iterator[pa.RecordBatch]:
        first = unit * at_once
        numbers = np.empty(min(at_once, groups - first), width)
        filled = 0
        for hashes in md5_numbers(b"%d:%d:" % (seed, replicate), first, first + len(numbers)):
            numbers[filled : filled + len(hashes)] = hashes % np.uint64(groups)
            filled += len(hashes)
        numbers.sort()
        edges = np.searchsorted(numbers, starts)
        drawn = np.flatnonzero(np.diff(edges))
        for some in np.array_split(drawn, -(-len(drawn) * block // BATCH_BYTES)):
            counts = [
                np.bincount((numbers[edges[i] : edges[i + 1]] - starts[i]).astype(np.int64), minlength=block) for i in some
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int64)),
                    pa.array(np.full(len(some), replicate, np.int32)),
                    pa.array([_packed(c) for c in counts], pa.binary()),
                ],
                names=["block", "replicate", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                yield from counted(*divmod(number, units))

    return run


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _unpacked(counts: bytes | pa.Buffer, length: int) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) // length}")


def _numbered_draws(block: int):
    """Counts of a block to (number, replicate, times), one row for each number that is drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, replicate, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "replicate", "counts"))):
                times = _unpacked(counts, block)
                drawn = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(drawn + at * block),
                        pa.array(np.full(len(drawn), replicate, np.int32)),
                        pa.array(times[drawn].astype(np.int64)),
                    ],
                    names=["number", "replicate", "times"],
                )

    return run


def drawn_times(spark: SparkSession, replicates: int, groups: int, seed: int = SEED, block: int = 0) -> DataFrame:
    """``(number, replicate, times)``: how often each replicate draws each group, if it does.

    Draws are counted where they are hashed, and their counts dealt by group once. With ``block``, groups stay packed:
    ``(block, replicate, counts)``, a number for each of so many neighbouring groups; rows of one block and
    replicate add up. A group is drawn about once a replicate, so none is hot.
    """
    units = replicates * -(-groups // COUNTED_DRAWS)
    tasks = max(spark.sparkContext.defaultParallelism, -(-replicates * groups // TASK_DRAWS))
    size = block or max(1, min(groups, BATCH_BYTES))
    ids = spark.range(0, units, 1, max(1, min(units, tasks)))
    packed = ids.mapInArrow(_counted_draws(seed, groups, size), "block bigint, replicate int, counts binary")
    if block:
        return packed
    draws = packed.mapInArrow(_numbered_draws(size), "number bigint, replicate int, times bigint")
    return draws.repartition("number").groupBy("number", "replicate").agg(F.sum("times").alias("times"))


def _drawn_rows(replicates: int, block: int):
    """Rows sorted by block, counts of draws first, then scores and labels, to (score, label, counts).

    ``counts`` has a number for each replicate: how often the rows of that score and label are drawn. Those of
    other blocks have to be added. A task holds the counts of one block and one batch of rows.
    """

    def added(table: np.ndarray, replicate: int, counts: np.ndarray) -> np.ndarray:
        total = table[replicate] + counts.astype(np.int64)
        table = table.astype(np.promote_types(table.dtype, np.min_scalar_type(int(total.max()))), copy=False)
        table[replicate] = total
        return table

    def drawn(table: np.ndarray, members: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(replicates, np.int64)
        for at in range(0, len(members), ADDED_ROWS):
            taken, times = table[members[at : at + ADDED_ROWS]], rows[at : at + ADDED_ROWS]
            total += taken.sum(axis=0, dtype=np.uint32 if taken.itemsize < 4 else np.int64)
            more = times > 1
            if more.any():
                total += (times[more] - 1) @ taken[more].astype(np.int64)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table = None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for start, stop in _runs(blocks):
                part = batch.slice(start, stop - start)
                if held != blocks[start]:
                    held, table, by_member = blocks[start], np.zeros((replicates, block), np.uint8), None
                counted = part.num_rows - part.column("replicate").null_count
                for replicate, counts in zip(part.column("replicate").to_pylist()[:counted], part.column("counts")):
                    table = added(table, replicate, _unpacked(counts.as_buffer(), block))
                part = part.slice(counted)
                if not part.num_rows:
                    continue
                if by_member is None:
                    table, by_member = None, np.ascontiguousarray(table.T)
                scores, labels = part.column("score"), part.column("label")
                members, rows = (part.column(c).to_numpy() for c in ("member", "rows"))
                values = scores.to_numpy(zero_copy_only=False).view(np.int64)
                runs = list(_runs(values, labels.fill_null(-1).to_numpy()))
                firsts = pa.array([first for first, _ in runs], pa.int64())
                totals = [_packed(drawn(by_member, members[i:j], rows[i:j])) for i, j in runs]
                yield pa.RecordBatch.from_arrays(
                    [scores.take(firsts), labels.take(firsts), pa.array(totals, pa.binary())], names=["score", "label", "counts"]
                )

    return run


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    changed = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(keys[0])]
    return zip(edges[:-1], edges[1:])


def _added_rows(replicates: int):
    """Rows (score, label, counts) sorted by score and label to (replicate, score, label, times), if drawn."""

    def spread(score: float | None, label: int | None, total: np.ndarray) -> pa.RecordBatch:
        drawn = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(drawn.astype(np.int32)),
                pa.array([score] * len(drawn), pa.float64()),
                pa.array([label] * len(drawn), pa.int32()),
                pa.array(total[drawn]),
            ],
            names=["replicate", "score", "label", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = None
        for batch in batches:
            for *key, counts in zip(*(batch.column(c).to_pylist() for c in ("score", "label", "counts"))):
                if key != held:
                    if held is not None:
                        yield spread(*held, total)
                    held, total = key, np.zeros(replicates, np.int64)
                total += _unpacked(counts, replicates)
        if held is not None:
            yield spread(*held, total)

    return run


def resampled_metrics(
    predictions: DataFrame,
    group: str,
    score: str = "score",
    label: str = "label",
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """``ranking_metrics`` of each replicate: as many groups as there are, drawn with replacement.

    All rows of a group come as often as it was drawn. Groups are numbered in ascending order of
    ``group``; rows without a group are left out. An empty table gives an empty result.

    Groups are dealt in blocks of neighbouring numbers, which meet the draws of all replicates as one table.
    Only sums for each score and label leave a block, so rows times replicates are never a table.
    """
    spark = predictions.sparkSession
    rows = predictions.where(F.col(group).isNotNull()).withColumnRenamed(group, "member")
    # Scores of a group are counted first, so a group with many rows is dealt as few.
    counted = write_through(score_counts(rows, score, label, ["member"]), "counted")
    numbered = dense_ids(counted.select("member").distinct(), [F.col("member")], "number")
    groups = numbered.count()
    if not groups or not replicates:
        return ranking_metrics(
            predictions.where(F.lit(False)).select(F.lit(0).alias("replicate"), score, label), score, label, ["replicate"]
        )
    block = max(1, min(groups, TABLE_BYTES // replicates))
    times = drawn_times(spark, replicates, groups, seed, block)
    outcomes = F.array(
        *[
            F.struct(F.lit(value).alias("label"), F.col(name).alias("rows"))
            for name, value in (("positives", 1), ("negatives", 0), ("unusable", None))
        ]
    )
    flat = counted.join(numbered, "member").select("number", "score", F.explode(outcomes).alias("of")).where("of.rows > 0")
    flat = flat.select(
        F.expr(f"number div {block}").alias("block"),
        (F.col("number") % block).alias("member"),
        "score",
        F.col("of.label").alias("label"),
        F.col("of.rows").alias("rows"),
    )
    met = times.unionByName(flat, allowMissingColumns=True).repartition("block")
    met = met.sortWithinPartitions("block", F.col("replicate").asc_nulls_last(), "score", "label")
    drawn = met.mapInArrow(_drawn_rows(replicates, block), "score double, label int, counts binary")
    drawn = drawn.repartition("score", "label").sortWithinPartitions("score", "label")
    drawn = drawn.mapInArrow(_added_rows(replicates), "replicate int, score double, label int, times bigint")
    return ranking_metrics(drawn, "score", "label", ["replicate"], "times")


def bootstrap_intervals(
    predictions: DataFrame,
    group: str,
    score: str = "score",
    label: str = "label",
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """``(metric, low, high, used, skipped)``: the 95 % interval of each metric over replicates.

    Replicates with one class are skipped and counted. Ends are nearest ranks: the value at
    ceil(share * used) in ascending order, null if no replicate was used.
    """
    found = resampled_metrics(predictions, group, score, label, replicates, seed)
    pair = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auroc", "average_precision")])
    )
    values = found.select(pair.alias("pair")).select("pair.*")
    gathered = values.groupBy("metric").agg(  # one value a replicate
        F.sort_array(F.collect_list("value")).alias("all"), F.count_if(F.col("value").isNull()).alias("skipped")
    )
    used = F.size("all")

    def end(share: float) -> Column:
        return F.get("all", F.greatest(F.ceil(used * F.lit(share)), F.lit(1)).cast("int") - 1)

    low, high = INTERVAL
    return gathered.select(
        "metric", end(low).alias("low"), end(high).alias("high"), used.cast("bigint").alias("used"), "skipped"
    )


def result_summary(
    predictions: DataFrame, group: str, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, patients, stays, positive_stays, negative_stays, auroc, average_precision, note)``.

    Counts cover all rows, those without a score or label too; ``group`` names the patient, null ids
    are none. Groups of ``by`` may be null.
    """
    counts = predictions.groupBy(*by).agg(
        F.count_distinct(group).alias("patients"),
        F.count(F.lit(1)).alias("stays"),
        F.count_if(F.col(label) == 1).alias("positive_stays"),
        F.count_if(F.col(label) == 0).alias("negative_stays"),
    )
    found = ranking_metrics(predictions, score, label, by).select(
        *[F.col(c).alias(f"__{c}") for c in by], "auroc", "average_precision", "note"
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return counts.join(found, same or F.lit(True)).drop(*[f"__{c}" for c in by])

"""Splits and folds that keep groups whole and label shares alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.operators.running import running_totals
from chartweave.operators.shared_storage import write_through

#: Parts of the split and their shares of the stays, in percent.
PARTS = (("train", 70), ("validation", 15), ("test", 15))
SEED, FOLDS = 42, 5
#: Groups whose split or fold may be broadcast to their stays.
MAX_BROADCAST_GROUPS = 500_000
#: Groups that the assignment of folds may hold in one row.
MAX_FOLD_GROUPS = 50_000


def hash_rank(seed: int, key: Column) -> Column:
    """A text that orders keys as if at random, the same everywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _joined(stays: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    few = groups.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    return stays.join(F.broadcast(groups) if few else groups, on, "left")


def group_split(
    stays: DataFrame,
    group: str,
    label: str = "label",
    seed: int = SEED,
    parts: Sequence[tuple[str, int]] = PARTS,
    column: str = "part",
) -> DataFrame:
    """``stays`` with the part as a new column; all stays of a group come into the same one.

    A group's stratum is its highest label. Within a stratum groups are ordered by a hash of seed and
    group; a group belongs to the part in which the middle of its stays falls when stays are
    counted along that order. Each cut is thus off by half a group's stays at most, in every
    stratum, and depends on nothing but the rows: neither their order nor the partitioning.

    Stays without a group have no part (null). Labels may be null; groups without any label are
    a stratum of their own. An empty table gives an empty result.
    """
    groups = (
        stays.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.max(label).alias("__stratum"), F.count(F.lit(1)).alias("__stays"))
        .withColumn("__rank", hash_rank(seed, F.col(group)))
    )
    ranked = running_totals(groups, ["__stratum"], [F.col("__rank"), F.col(group)], ["__stays"])
    sizes = ranked.groupBy("__stratum").agg(F.sum("__stays").alias("__all"))  # one row a label value
    ranked = ranked.join(F.broadcast(sizes), ranked["__stratum"].eqNullSafe(sizes["__stratum"]))
    middle = (2 * F.col("__stays_before") + F.col("__stays")) * F.lit(sum(share for _, share in parts))
    reached, part = 0, F.lit(parts[-1][0])
    chosen: Column | None = None
    for name, share in parts[:-1]:
        reached += share
        inside = middle < 2 * reached * F.col("__all")
        chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
    part = part if chosen is None else chosen.otherwise(part)
    placed = write_through(ranked.select(group, part.alias(column)), "split")
    return _joined(stays, placed, group)


def split_violations(
    stays: DataFrame,
    stay: str,
    group: str,
    label: str = "label",
    part: str = "part",
    parts: Sequence[str] = tuple(name for name, _ in PARTS),
) -> DataFrame:
    """``(rule, detail)`` of all that is wrong with a split; empty if nothing is.

    Rules: ``group_in_two_parts`` and ``stay_in_two_parts``, with the id; ``stay_without_part``;
    ``stay_twice`` for a stay that occurs several times in one part; ``class_missing``, with the
    part and label that has no stay.
    """

    def ids(rule: str, key: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("detail"))

    def spread(key: str) -> DataFrame:
        ends = F.min(part).alias("low"), F.max(part).alias("high"), F.count(F.lit(1)).alias("n")
        return stays.where(F.col(key).isNotNull()).groupBy(key).agg(*ends)

    by_stay = spread(stay)
    spark = stays.sparkSession
    wanted = [(p, value) for p in parts for value in (0, 1)]
    classes = spark.createDataFrame(wanted, "part string, label int")
    present = stays.select(F.col(part).alias("part"), F.col(label).cast("int").alias("label")).distinct()
    missing = classes.join(F.broadcast(present), ["part", "label"], "left_anti")
    return (
        ids("group_in_two_parts", group, spread(group).where("low <> high"))
        .unionByName(ids("stay_in_two_parts", stay, by_stay.where("low <> high")))
        .unionByName(ids("stay_twice", stay, by_stay.where("low = high AND n > 1")))
        .unionByName(ids("stay_without_part", stay, stays.where(F.col(part).isNull())))
        .unionByName(
            missing.select(
                F.lit("class_missing").alias("rule"), F.concat_ws(" ", "part", F.col("label").cast("string")).alias("detail")
            )
        )
    )


def group_folds(stays: DataFrame, group: str, label: str = "label", folds: int = FOLDS, column: str = "fold") -> DataFrame:
    """``stays`` with the fold, from 0, as a new column; all stays of a group come into the same one.

    Groups are placed one after another, largest first (stays downwards, then group), each into the
    fold with the smallest sum of two shares, that of all stays and that of all positives; of equal
    ones the lowest fold. Folds end about equal in both if no group is larger than a fold.

    Groups are sites, of which there are few: one row holds the counts of all, and more than
    ``MAX_FOLD_GROUPS`` are refused. Stays are only counted, then joined. Stays without a group
    have no fold (null); labels other than 1 are no positives.
    """
    counts = write_through(
        stays.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")),
        "fold-groups",
    )
    size = counts.limit(MAX_FOLD_GROUPS + 1).count()
    if size > MAX_FOLD_GROUPS:
        raise ValueError(f"more than {MAX_FOLD_GROUPS} groups: folds are for sites")
    wide = "decimal(38,0)"
    one = F.struct((-F.col("n")).alias("rank"), F.col(group).alias("key"), F.col("n"), F.col("p"))
    gathered = counts.agg(
        F.sort_array(F.collect_list(one)).alias("groups"), F.sum("n").cast(wide).alias("all_n"), F.sum("p").cast(wide).alias("all_p")
    )
    nothing = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), folds).alias("n"),
        F.array_repeat(F.lit(0).cast("bigint"), folds).alias("p"),
        F.lit(-1).alias("last"),
        F.array().cast("array<int>").alias("placed"),
    )

    def place(state: Column, item: Column) -> Column:
        # n / all_n + p / all_p, times all_n * all_p; without a positive only stays count.
        loads = F.transform(
            F.sequence(F.lit(0), F.lit(folds - 1)),
            lambda f: F.struct(
                (
                    F.get(state["n"], f).cast(wide) * F.greatest(F.col("all_p"), F.lit(1).cast(wide))
                    + F.get(state["p"], f).cast(wide) * F.col("all_n")
                ).alias("load"),
                f.alias("fold"),
            ),
        )
        best = F.array_min(loads)["fold"]

        def added(name: str) -> Column:
            return F.transform(state[name], lambda x, f: F.when(f == best, x + item[name]).otherwise(x)).alias(name)

        return F.struct(added("n"), added("p"), best.alias("last"), F.concat(state["placed"], F.array(best)).alias("placed"))

    fold = F.aggregate("groups", nothing, place)["placed"].alias("fold")
    placed = gathered.select(F.col("groups.key").alias("key"), fold).select(
        F.explode(F.arrays_zip("key", "fold")).alias("x")
    )
    placed = write_through(placed.select(F.col("x.key").alias(group), F.col("x.fold").alias(column)), "folds")
    return _joined(stays, placed, group)

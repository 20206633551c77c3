"""Rare n-grams of training streams that come back in held-out ones, as aggregate counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES, MAX_COUNT = (3, 4, 5), 3


def ngram_counts(streams: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """``(size, gram, occurrences)`` over all streams (arrays ``events``); counts merge before the shuffle."""
    def grams_of(k: int) -> Column:
        starts = F.when(F.size("events") >= k, F.sequence(F.lit(1), F.size("events") - k + 1))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(F.lit(k).alias("size"), F.slice("events", i, k).alias("gram")),
        )

    grams = F.flatten(F.array(*[grams_of(k) for k in sizes]))
    rows = streams.where("events IS NOT NULL").select(F.explode(grams).alias("g")).select("g.*")
    return rows.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("occurrences"))


def rare_overlap(
    training: DataFrame, held_out: DataFrame, sizes: Sequence[int] = SIZES, max_count: int = MAX_COUNT
) -> DataFrame:
    """One row per size: how many n-grams that are rare in training streams occur in held-out ones.

    ``(size, training_ngrams, rare_ngrams, held_out_ngrams, held_out_occurrences, shared_ngrams,
    shared_rare_ngrams, shared_rare_occurrences)``; rare means at most ``max_count`` occurrences in
    training. N-grams and stays themselves never leave: only these counts do. Each n-gram is one row on
    either side before they meet, so a frequent one crowds no task. Null tokens equal one another.
    """
    spark = training.sparkSession
    # Both sides in one shuffle: an n-gram's two counts meet in its own row.
    marked = [
        ngram_counts(side, sizes).select("size", "gram", *[
            (F.col("occurrences") if name == own else F.lit(0).cast("bigint")).alias(name) for name in ("learned", "seen")
        ])
        for side, own in ((training, "learned"), (held_out, "seen"))
    ]
    grams = marked[0].unionByName(marked[1]).groupBy("size", "gram").agg(
        F.sum("learned").alias("learned"), F.sum("seen").alias("seen")
    )
    learned, seen = F.col("learned") > 0, F.col("seen") > 0
    rare = learned & (F.col("learned") <= max_count)
    counts = grams.groupBy("size").agg(
        F.count_if(learned).alias("training_ngrams"),
        F.count_if(rare).alias("rare_ngrams"),
        F.count_if(seen).alias("held_out_ngrams"),
        F.sum("seen").alias("held_out_occurrences"),
        F.count_if(learned & seen).alias("shared_ngrams"),
        F.count_if(rare & seen).alias("shared_rare_ngrams"),
        F.sum(F.when(rare, F.col("seen")).otherwise(0)).alias("shared_rare_occurrences"),
    )
    wanted = spark.createDataFrame([(k,) for k in sizes], "size int")
    return wanted.join(counts, "size", "left").fillna(0)


def accuracy_by_frequency(
    predictions: DataFrame, vocabulary: DataFrame, edges: Sequence[int] = (10, 100, 1000)
) -> DataFrame:
    """``(stratum, predictions, correct, accuracy)``: hits of predicted ids by the training count of the true one.

    ``predictions`` has ``target_id`` and ``predicted_id``; rows with a negative or null target are not
    predictions. ``stratum`` is the least edge that the count stays below (null: none, or no count, as for
    special tokens). Targets are counted before the join.
    """
    rows = predictions.where("target_id >= 0").groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_id") == F.col("predicted_id")).alias("hits")
    )
    known = rows.join(vocabulary.select(F.col("id").alias("target_id"), "count"), "target_id", "left")
    stratum = F.lit(None).cast("int")
    for edge in sorted(edges, reverse=True):
        stratum = F.when(F.col("count") < edge, F.lit(edge)).otherwise(stratum)
    found = known.groupBy(stratum.alias("stratum")).agg(F.sum("n").alias("predictions"), F.sum("hits").alias("correct"))
    return found.withColumn("accuracy", F.col("correct").cast("double") / F.col("predictions").cast("double"))

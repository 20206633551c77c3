"""Packing documents into padded batches with optimal length buckets.

A global histogram of lengths goes to the driver (its size depends on the resolution, not
on the corpus). Dynamic programming chooses the bucket boundaries that minimise padding
over all documents. Inside a bucket documents get consecutive numbers, and as many as
fit the token budget at the bucket's boundary form a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from chartweave.llm.shared import identified, located, write_through

#: Lengths up to this have a bin each; longer ones 64 bins for each doubling.
FINE = 4096
_PER_DOUBLING = 64
BUCKETS = 16
#: Padded tokens of a batch; one longer document is a batch of its own.
TOKEN_BUDGET = 65_536
#: Documents that are numbered together in one task.
NUMBERED_ROWS = 500_000


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _bin(length: Column) -> Column:
    coarse = F.ceil(F.log2(length / FINE) * _PER_DOUBLING).cast("long")
    return F.when(length <= FINE, length).otherwise(FINE + coarse)


def bucket_ends(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``lengths`` are ascending and distinct. Of equal solutions the one with earlier ends is taken.
    """
    m = len(lengths)
    if not m:
        return []
    lengths = lengths.astype(np.float64)
    total = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    mass = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (total[j] - total[:j]) - (mass[j] - mass[:j])
            cut[j] = int(cost.argmin())
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = new
    ends, j = [], m
    for cut in reversed(cuts):
        if not j:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def pack_batches(
    docs: DataFrame,
    length: Column | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch_id, slot), one row per row of ``docs``.

    ``length`` is an expression over the struct ``row``; words by default. Batches are
    numbered from 0 through all buckets, slots from 0 in a batch; batch_id and slot are unique
    together. Null and empty texts have length 0. Null ids, repeated rows and ties are ordinary rows.
    An empty table gives an empty result; columns of other names are ignored.
    """
    docs = located(docs)
    size = word_count(F.col("row")[text]) if length is None else length
    rows = write_through(
        identified(docs).select(
            "__file", "__row", F.col("row")[doc_id].alias("doc_id"), size.cast("long").alias("n_tokens")
        ),
        "lengths",
    )
    bins = (
        rows.groupBy(_bin(F.col("n_tokens")).alias("bin"))
        .agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
        .collect()
    )
    tops, counts = np.array([b["top"] for b in bins]), np.array([b["n"] for b in bins])
    ends = bucket_ends(tops, counts, buckets)
    if not ends:
        ends = [0]
    per_batch = [max(1, token_budget // max(1, end)) for end in ends]
    held = [int(counts[(tops <= end) & (tops > low)].sum()) for low, end in zip([-1, *ends], ends)]
    first = np.concatenate(([0], np.cumsum([-(-n // k) for n, k in zip(held, per_batch)])))
    bucket = F.lit(0)
    for i, end in enumerate(ends[:-1]):
        bucket = F.when(F.col("n_tokens") > end, F.lit(i + 1)).otherwise(bucket)
    # Each bucket is numbered in parts of bounded size, however many of all rows it holds.
    parts = max(1, -(-int(sum(held)) // NUMBERED_ROWS))
    placed = rows.withColumn("bucket", bucket).withColumn(
        "part", F.pmod(F.xxhash64("__file", "__row"), F.lit(parts)).cast("int")
    )
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("base")
    )
    own = Window.partitionBy("bucket", "part").orderBy("doc_id", "__file", "__row")
    numbered = placed.withColumn("place", F.row_number().over(own)).join(before, ["bucket", "part"])

    def pick(values) -> Column:
        return F.array(*[F.lit(int(v)).cast("long") for v in values])[F.col("bucket")]

    index = F.col("base") + F.col("place") - 1
    return numbered.select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        pick(ends).alias("padded_to"),
        (pick(first[:-1]) + F.floor(index / pick(per_batch))).cast("long").alias("batch_id"),
        F.pmod(index, pick(per_batch)).cast("int").alias("slot"),
    )

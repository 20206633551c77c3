"""Exact top-k by inner product of integer vectors, with MaxScore over shards of candidates.

A query's terms are its non-zero dimensions; a posting is a candidate's entry in one
dimension. In a shard every term has a score bound: the largest product that the query's
weight can make with any entry. Terms are ordered by bound; those whose bounds
together cannot lift a candidate over the query's k-th score so far are non-essential.
Essential postings are summed for all candidates of a piece of the shard; of the
others, terms are probed one after another, and only for candidates whose sum plus the bounds that
remain is still competitive. The best of the shards are merged by a ranking in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chartweave.llm.shared import packed

#: Rows of a shard of candidates and of a block of queries, at the most expected size.
SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: Candidates that are taken at once, after which the k-th scores are raised.
PIECE_ROWS = 512
#: Most tasks that the pairs of blocks are dealt to, and the limit of a score.
MAX_TASKS = 20_000
MAX_SCORE = 2**63 - 1


def best_of_shard(
    queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, shard_ids: np.ndarray, k: int
) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in a shard, by MaxScore; exact integers.

    Scores beyond 64 bits are set to the limit that they pass.
    """
    if not len(shard) or not len(queries):
        return
    # Products and sums stay exact: in int64 if they fit, else as Python's integers.
    largest = max((abs(int(x)) for m in (queries, shard) for x in (m.max(), m.min())), default=0)
    kind = np.int64 if largest * largest * shard.shape[1] < 2**62 else object
    shard, order = shard.astype(kind), np.argsort(shard_ids, kind="stable")
    shard, shard_ids = shard[order], shard_ids[order]
    high, low = shard.max(axis=0), shard.min(axis=0)
    for weight, own in zip(queries.astype(kind), query_ids.tolist(), strict=True):
        terms = np.flatnonzero(weight != 0)
        bound = np.maximum(weight[terms] * high[terms], weight[terms] * low[terms])
        # Terms with the widest range first: they tell candidates apart soonest.
        wide = np.abs(weight[terms] * (high[terms] - low[terms]))
        by = np.argsort(-wide, kind="stable")
        terms, bound = terms[by], bound[by]
        rest = np.append(np.cumsum(bound[::-1])[::-1], kind(0) if kind is not object else 0)
        top_scores, top_ids, least = np.empty(0, kind), np.empty(0, np.int64), None
        for at in range(0, len(shard), PIECE_ROWS):
            piece, ids = shard[at : at + PIECE_ROWS], shard_ids[at : at + PIECE_ROWS]
            left = np.flatnonzero(ids != own)
            score = np.zeros(len(left), kind)
            # Non-essential: the last terms that alone can't reach the k-th score.
            essential = 0
            if least is not None:
                essential = int(np.count_nonzero(rest[:-1] >= least))
                score = piece[left][:, terms[:essential]] @ weight[terms[:essential]]
            for step in range(essential, len(terms), 8):
                if least is not None:
                    keep = score + rest[step] >= least
                    left, score = left[keep], score[keep]
                    if not len(left):
                        break
                some = terms[step : step + 8]
                score = score + piece[left][:, some] @ weight[some]
            if kind is object:  # bounds stay above the limit, so nothing that ties there is left out
                score = np.array([max(-MAX_SCORE, min(MAX_SCORE, int(x))) for x in score], object)
            top_scores = np.concatenate((top_scores, score))
            top_ids = np.concatenate((top_ids, ids[left]))
            if len(top_scores) > k:
                best = np.lexsort((top_ids, -top_scores)) if kind is not object else np.array(
                    sorted(range(len(top_scores)), key=lambda i: (-top_scores[i], top_ids[i]))
                )
                top_scores, top_ids = top_scores[best[:k]], top_ids[best[:k]]
            if len(top_scores) == k:
                least = top_scores.min()
        for other, value in zip(top_ids.tolist(), top_scores.tolist(), strict=True):
            yield own, other, int(value)


def _flat(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    values = batch.column(name)[row].values
    if pa.types.is_list(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, c_ids, copies = (_flat(batch, c, i) for c in ("q_ids", "c_ids", "c_copies"))
                queries = _flat(batch, "q_vectors", i).reshape(len(q_ids), -1)
                shard = np.repeat(_flat(batch, "c_vectors", i).reshape(len(c_ids), -1), copies, axis=0)
                rows = list(best_of_shard(queries, q_ids, shard, np.repeat(c_ids, copies), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def integer_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, ints): floor(scale * x) of each component, without unusable vectors.

    Vectors that are null, or hold null or non-finite components, and rows without an id take no part.
    """
    doubles = F.transform(F.col("row")[vector], lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        packed(table)
        .select(F.col("row")[vec_id].cast("long").alias("vec_id"), doubles.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
        .select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("ints"))
    )


def _blocks(rows: DataFrame, count: int, prefix: str) -> DataFrame:
    """Rows in ``count`` blocks by a hash of the row, vectors of one length together."""
    block = F.pmod(F.xxhash64("vec_id", "ints"), F.lit(count)).alias(f"{prefix}_block")
    return (
        rows.groupBy(block, F.size("ints").alias(f"{prefix}_size"))
        .agg(F.collect_list(F.struct("vec_id", "ints", "copies")).alias("rows"))
        .select(
            f"{prefix}_block",
            f"{prefix}_size",
            F.col("rows.vec_id").alias(f"{prefix}_ids"),
            F.flatten("rows.ints").alias(f"{prefix}_vectors"),
            F.col("rows.copies").alias(f"{prefix}_copies"),
        )
    )


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row.

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows whose id isn't
    the query's own and whose vector has its length; ties go to the smaller id, and repeated
    rows are candidates each. Equal query rows are asked once. Different vectors under one id are
    candidates each; as queries their results are ranked as one list. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. Components and scores beyond
    64 bits are set to the limit that they pass. Other columns are ignored; an empty table gives an empty result.

    Every block of queries meets every shard, each pair in a task of its own up to ``MAX_TASKS``: exact search shuffles
    rows * queries / ``QUERY_ROWS`` vectors.
    """
    rows = integer_vectors(table, vec_id, vector, scale)
    asked = rows.where(is_query).distinct().withColumn("copies", F.lit(1))
    # Equal rows are one posting with a count; more than k copies can't change a result.
    stored = rows.groupBy("vec_id", "ints").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    # Blocks are hashed, with counts that follow the input, so none grows with it.
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    tasks = min(2 * blocks * shards, MAX_TASKS)

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    key = ["q_block", "c_block", "size"]
    left = _blocks(asked, blocks, "q").withColumnRenamed("q_size", "size").withColumn("c_block", every(shards))
    right = _blocks(stored, shards, "c").withColumnRenamed("c_size", "size").withColumn("q_block", every(blocks))
    pairs = right.repartition(tasks, *key).join(left.repartition(tasks, *key), key)
    found = pairs.select("q_ids", "q_vectors", "c_ids", "c_vectors", "c_copies").mapInArrow(
        _searched(k), "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

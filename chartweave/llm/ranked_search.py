"""Ranked lexical search with bag deduplication.

To the items of a query set, a document is only the counts of the items' own terms and a
length factor m. Documents with equal counts and m form a class: they are grouped by a hash
together with the counts themselves, so that equal hashes alone never merge two. Each class is
scored once against all items; the best classes of an item are then expanded to their members in
ascending order of ids.

An item's best documents lie in its best classes: of classes ordered by (score, smallest id), each
one puts at least its smallest member before any document of later ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from chartweave.llm.shared import ROW_KEY, identified, located, restricted, write_through

#: Bytes of item texts whose vocabulary tasks hold at once; further items are further blocks.
ITEM_BYTES = 16 << 20
#: Scores of classes and items that a task holds at once.
SCORES = 1 << 20
#: Postings of classes that a task spreads over items at once.
SPREAD = 1 << 21

_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, A-Z, a-z and characters from U+0080 on; only A-Z lowered."""
    return (text or "").encode().translate(_TERM).split()


class Items:
    """A block of items: its terms, and which items hold each of them how often."""

    def __init__(self, texts: list[str | None]) -> None:
        bags = [Counter(terms_of(t)) for t in texts]
        self.count = len(texts)
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
        held: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for item, bag in enumerate(bags):
            for term, times in bag.items():
                held[self.terms[term]].append((item, times))
        self.starts = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int64)
        flat = np.array([pair for h in held for pair in h], np.int64).reshape(-1, 2)
        self.items, self.times = flat[:, 0], flat[:, 1]


def _bags(vocabulary: dict[bytes, int]):
    """Number of terms of each text, and its counts of the items' terms: ids, then counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column("text"):
                terms = terms_of(text.as_py())
                sizes.append(len(terms))
                known = [vocabulary[t] for t in terms if t in vocabulary]
                ids, counts = np.unique(np.array(known, np.uint32), return_counts=True)
                bags.append(np.concatenate((ids, counts)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in (*ROW_KEY, "doc_id")],
                    pa.array(sizes, pa.int64()),
                    pa.array(bags, pa.binary()),
                ],
                names=[*ROW_KEY, "doc_id", "n", "bag"],
            )

    return run


def _unpacked(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every posting."""
    arrays = [np.frombuffer(b.as_py(), "<u4") for b in bags]
    half = [len(a) // 2 for a in arrays]
    if not sum(half):
        return (np.empty(0, np.int64),) * 3
    ids = np.concatenate([a[:n] for a, n in zip(arrays, half, strict=True)]).astype(np.int64)
    counts = np.concatenate([a[n:] for a, n in zip(arrays, half, strict=True)]).astype(np.int64)
    return np.repeat(np.arange(len(arrays)), half), ids, counts


def _holders(size: int):
    """How many bags hold each term, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(_unpacked(batch.column("bag"))[1], minlength=size)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["term", "df"])

    return run


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of each item: highest score, then smallest id, null ids last."""
    ids = pc.rank(table["first"].combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="min")
    item, score = table["item"].to_numpy(), table["score"].to_numpy()
    order = np.lexsort((ids.to_numpy(), -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return table.take(pa.array(order[place < k]))


def class_scores(index: Items, weight: np.ndarray, bags: pa.Array, m: np.ndarray) -> np.ndarray:
    """Scores of classes (rows) for items (columns), in 64-bit integers."""
    row, term, tf = _unpacked(bags)
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    out = np.zeros(len(m) * index.count, np.int64)
    spread = index.starts[term + 1] - index.starts[term]
    ends = np.cumsum(spread)
    first = 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - spread[first] + SPREAD, "right")))
        n = spread[first:last]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spot = np.repeat(index.starts[term[first:last]], n) + within
        own = np.repeat(row[first:last], n) * index.count + index.items[spot]
        np.add.at(out, own, np.repeat(part[first:last], n) * index.times[spot])
        first = last
    return out.reshape(len(m), index.count)


def _scored(index: Items, weight: np.ndarray, k: int):
    """The k best classes of each item, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        least = np.ones(index.count, np.int64)
        step = max(1, SCORES // max(1, index.count))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                scores = class_scores(index, weight, rows.column("bag"), rows.column("m").to_numpy())
                own, item = np.nonzero(scores >= least)
                found = pa.table(
                    {
                        "item": pa.array(item),
                        "score": pa.array(scores[own, item]),
                        **{c: rows.column(c).take(pa.array(own)) for c in ("first", *ROW_KEY)},
                    }
                )
                best = _best(found if best is None else pa.concat_tables([best, found]), k)
                items = best["item"].to_numpy()
                full = np.flatnonzero(np.bincount(items, minlength=index.count) == k)
                least[full] = best["score"].to_numpy()[np.searchsorted(items, full, "right") - 1]
        if best is not None:
            yield from best.to_batches()

    return run


def _ranked(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(rows: DataFrame, items: list, kind: str, k: int) -> DataFrame:
    """The best documents of the items of one block."""
    spark = rows.sparkSession
    index = Items([r["text"] for r in items])
    keys = f"__file bigint, __row bigint, doc_id {dict(rows.dtypes)['doc_id']}"
    bags = write_through(rows.mapInArrow(_bags(index.terms), f"{keys}, n bigint, bag binary"), "bags")
    documents, total = bags.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    held = np.zeros(len(index.terms), np.int64)
    found = bags.mapInArrow(_holders(len(index.terms)), "term bigint, df bigint")
    for term, df in found.groupBy("term").agg(F.sum("df")).collect():  # at most the block's terms
        held[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)

    # m = 75 + (25 * n * N) div L; the product may need more than 64 bits.
    factor = F.expr(f"75L + ((CAST(25 * n AS DECIMAL(20, 0)) * {documents}) div {total or 1}L)")
    bags = bags.where("octet_length(bag) > 0").withColumn("m", factor).withColumn("hash", F.xxhash64("bag", "m"))
    same = ["hash", "m", "bag"]
    # "first" is null only if no member has an id: min passes over nulls.
    least = F.min("doc_id").alias("first"), F.min(F.struct(*ROW_KEY)).alias("place")
    classes = write_through(bags.groupBy(*same).agg(*least).select(*same, "first", "place.*"), "bag-classes")
    best = classes.select("bag", "m", "first", *ROW_KEY).mapInArrow(
        _scored(index, weight, k),
        f"item bigint, score bigint, first {dict(rows.dtypes)['doc_id']}, __file bigint, __row bigint",
    )
    best = _ranked(best, ["item"], [F.desc("score"), F.asc_nulls_last("first")], k).drop("rank", "first")
    best = write_through(best, "best-classes")
    chosen = write_through(restricted(classes, best, ROW_KEY).select(*ROW_KEY, *same), "chosen-classes")
    members = restricted(bags.select("doc_id", *same), chosen, ["hash", "m"])
    members = _ranked(members, same, [F.asc_nulls_last("doc_id")], k).drop("rank")
    expanded = best.join(chosen, ROW_KEY).join(members, same).select("item", "score", "doc_id")
    ranked = _ranked(expanded, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item bigint, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each item.

    The weight of a term is floor(1000 * ln((2N + 2) / (2df + 1))) in doubles; all else is in integers.
    N counts documents with a term, L all terms, n those of a document: m = 75 + (25 * n * N) div L,
    and the score sums weight * ((10**9 * tf) div (1000 * tf + 12 * m)) over an item's terms, repeats
    included. Equal scores rank by ascending id, null ids last.

    Null and empty texts have no term and find, or are found by, nothing. Repeated document rows are
    found each; each row of ``items`` is an item of its own, so repeated ids give repeated rankings.
    An empty table on either side gives an empty result; other columns are ignored. Items are a stated
    query set: they are dealt in blocks of about ITEM_BYTES, each of which meets all documents; one item
    is never split.
    """
    rows = identified(located(docs)).select(
        *ROW_KEY, F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].cast("string").alias("text")
    )
    asked = identified(located(items)).select(
        *ROW_KEY, F.col("row")[item_id].alias("item_id"), F.col("row")[item_text].cast("string").alias("text")
    )
    kind = dict(asked.dtypes)["item_id"]
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64(*ROW_KEY), F.lit(blocks)))
    found = [
        _block(rows, dealt.where(F.col("block") == b).orderBy(*ROW_KEY).collect(), kind, k) for b in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found)

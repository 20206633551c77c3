"""Source divergence audit by hash-consed segment trees over term ids.

Within a language every source has a count for each kept term. Terms are dealt to blocks; in
a block they get dense ids, in the order of their counts over all sources, and each source
becomes a segment tree over these ids. Trees are hash-consed level by level: subtrees with equal
counts are one node, within a source and between sources. Two trees are walked together from
their roots; equal pairs of nodes are merged with the number of times they were met, so each is
opened once and each pair of counts is priced once. Spark sums the prices of blocks.

Blocks bound a task: BLOCK_TERMS terms and two tiles of SOURCES sources, whatever the table's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from chartweave.llm.shared import hinted, write_through

#: A term is kept if so many documents of its language hold it.
MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Terms of a block and sources of a tile, about; a task holds one block for two tiles.
BLOCK_TERMS, SOURCES = 16_384, 48
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 1 << 19

_SCALE = 1_000_000_000
_TERM = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, per group and task."""
    times: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in times.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(n), pa.string()),
                    pa.array([source] * len(n), pa.string()),
                    terms,
                    pa.array(n.values(), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        times.clear()

    held = 0
    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for text, group in zip(batch.column("text"), groups, strict=True):
            terms = text.as_py().encode().translate(_TERM).split()
            n, docs = times.setdefault(group, (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > HELD_TERMS:
                yield from rows()
                held = 0
    yield from rows()


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total) of each count, exactly."""
    if len(counts) and int(counts.max()) >= 2**63 // _SCALE - 1:
        return np.array([1 + _SCALE * (c + 1) // total for c in counts.tolist()], np.int64)
    return 1 + (_SCALE * (counts + 1)) // total


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Trees:
    """Hash-consed segment trees of some rows of counts over the same term ids."""

    def __init__(self, counts: np.ndarray) -> None:
        rows, width = counts.shape
        size = 1 << max(0, width - 1).bit_length()
        self.counts, codes = np.unique(counts, return_inverse=True)
        self.blank = len(self.counts)  # a leaf without a term
        ids = np.full((rows, size), self.blank, np.int64)
        ids[:, :width] = codes.reshape(rows, width)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        known = self.blank + 1
        while ids.shape[1] > 1:
            pairs, ids = np.unique(ids[:, ::2] * known + ids[:, 1::2], return_inverse=True)
            ids = ids.reshape(rows, -1)
            self.levels.append((pairs // known, pairs % known))
            known = len(pairs)
        self.roots = ids[:, 0]

    def together(self, row: int, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Walks the tree of one row with each of the others.

        Returns (place in ``others``, count of the row, count of the other, number of terms):
        the pairs of counts of each two rows, each once.
        """
        walk, times = np.arange(len(others)), np.ones(len(others), np.int64)
        left, right = np.full(len(others), self.roots[row]), self.roots[others]
        for low, high in reversed(self.levels):
            span = int(max(low.max(), high.max())) + 1
            pairs = np.concatenate(
                ((walk * span + low[left]) * span + low[right], (walk * span + high[left]) * span + high[right])
            )
            pairs, spots = np.unique(pairs, return_inverse=True)
            met = np.zeros(len(pairs), np.int64)
            np.add.at(met, spots, np.concatenate((times, times)))
            times, right = met, pairs % span
            walk, left = pairs // span // span, pairs // span % span
        real = left != self.blank
        return walk[real], self.counts[left[real]], self.counts[right[real]], times[real]


def _block_rows(top: int):
    """Prices of one block of terms: pairs of sources, and the best terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        heads = table.filter(pc.is_null(table["term"])).sort_by("source")
        whole_lang = table.filter(pc.is_null(table["source"]))
        terms = table.filter(pc.and_(pc.is_valid(table["term"]), pc.is_valid(table["source"])))
        names = heads["source"].to_pylist()
        lang, lang_n = table["lang"][0].as_py(), table["lang_n"][0].as_py()
        kept = table["kept"][0].as_py()
        tiles, sums = heads["tile"].to_numpy(), heads["n"].to_pylist()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()

        words = whole_lang["term"].combine_chunks()
        counts = np.zeros((len(names) + 1, len(words)), np.int64)
        counts[-1] = whole_lang["n"].to_numpy()
        row = pc.index_in(terms["source"], value_set=heads["source"].combine_chunks()).to_numpy()
        counts[row, pc.index_in(terms["term"], value_set=words).to_numpy()] = terms["n"].to_numpy()
        order = np.lexsort(counts)
        trees = Trees(counts[:, order])
        out = []
        for i, name in enumerate(names):
            whole = sums[i] + kept
            if tiles[i] == low:
                # Within a tile each two sources meet once, and so do those of two tiles.
                later = np.array([j for j in range(len(names)) if tiles[j] == high and (low != high or j > i)], np.int64)
                out += _pair_rows(trees, i, later, whole, [sums[j] + kept for j in later], names)
            if low == high and len(words):
                own = trees.together(i, np.array([len(names)]))
                _, mine, all_, _ = own
                p, q = shares(mine, whole), shares(all_, lang_n + kept)
                good = (mine > 0) & (p > q)
                priced = dict(zip(zip(mine[good].tolist(), all_[good].tolist()), price(p, q)[good].tolist()))
                pairs = zip(counts[i].tolist(), counts[-1].tolist())
                found = [(-priced[c], t) for c, t in zip(pairs, words.to_pylist()) if c in priced]
                out += [(name, "term", t, -f) for f, t in sorted(found)[:top]]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table(
            {
                "lang": pa.array([lang] * len(out), pa.string()),
                **{c: pa.array(columns[i], pa.string()) for i, c in enumerate(("source", "part", "item"))},
                "value": pa.array(columns[3], pa.int64()),
            }
        )

    return run


def _pair_rows(
    trees: Trees, i: int, later: np.ndarray, whole: int, wholes: list[int], names: list[str]
) -> list[tuple[str, str, str, int]]:
    """Both directions of one source with each of the later ones, summed over this block."""
    if not len(later):
        return []
    values = np.zeros((2, len(later)), np.int64)
    if trees.counts.size:
        walk, mine, other, times = trees.together(i, later)
        p = shares(mine, whole)
        ends = np.searchsorted(walk, np.arange(len(later) + 1))
        for k in range(len(later)):
            own = slice(ends[k], ends[k + 1])
            q = shares(other[own], wholes[k])
            values[:, k] = (price(p[own], q) * times[own]).sum(), (price(q, p[own]) * times[own]).sum()
    out = []
    for k, j in enumerate(later):
        out += [(names[i], "pair", names[j], int(values[0, k])), (names[j], "pair", names[i], int(values[1, k]))]
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to pairs of tiles; a tile meets itself once. Rows without a source go to all pairs."""
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    tile = F.when(F.col("source").isNotNull(), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("*", F.explode(tile).alias("tile"))
    first = F.when(F.col("source").isNotNull(), F.lit(0)).otherwise(F.col("tile"))
    rows = rows.select("*", F.explode(F.sequence(first, F.col("tiles") - 1)).alias("other"))
    ends = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    return rows.select("*", *ends).drop("other", "tiles")


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Terms are maximal runs of A-Z, a-z and characters from U+0080 on, with A-Z lowered; a language
    keeps the V terms of at least ``min_documents`` of its documents. A group's share of a term is
    p = 1 + floor(10**9 * (count + 1) / (N + V)), N its sum over kept terms; the distance of p from q
    is floor((p - q)**2 / q). Part "pair" sums it against each other source of the language, part
    "term" lists the ``top`` kept terms that occur in the group with p above the language's share.
    Ranks go by value downwards, then item in UTF-8 order. All arithmetic is exact up to 2 * 10**9
    kept terms of a language.

    Null texts, languages and sources are ''. Groups without terms take part in pairs; a language
    without kept terms gives pairs of value 0. Repeated rows count each; an empty table gives an empty
    result; other columns are ignored.
    """
    empty = F.lit("")
    rows = docs.select(
        *[F.coalesce(docs[f"`{c}`"].cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    counts = rows.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term")
    counts = write_through(counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = write_through(terms.where(F.col("docs") >= min_documents).drop("docs"), "kept-terms")
    kept = counts.drop("docs").join(terms, ["lang", "term"])
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    groups = rows.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("tiles"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK_TERMS)).cast("int")
    langs = tiles.join(sizes, "lang", "left").fillna(0, ["kept", "lang_n"]).withColumn("blocks", blocks)
    langs = write_through(langs, "languages")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["n"])

    # A head row brings each source and its sum to every block; rows without a source are the language's
    # own counts, the others those of sources.
    none = F.lit(None).cast("string")
    facts = ["kept", "lang_n", "tiles"]
    heads = groups.join(hinted(langs), "lang").select(
        "lang", "source", none.alias("term"), "n", *facts,
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    body = kept.select("lang", "source", "term", "n").unionByName(
        terms.select("lang", none.alias("source"), "term", F.col("total").alias("n"))
    )
    body = body.join(hinted(langs), "lang").select("lang", "source", "term", "n", *facts, block)
    dealt = _dealt(heads.unionByName(body))
    priced = dealt.groupBy("lang", "block", "low", "high").applyInArrow(
        _block_rows(top), "lang string, source string, part string, item string, value bigint"
    )
    priced = write_through(priced, "prices")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    best = priced.where("part = 'term'").select(*columns, rank).where(F.col("rank") <= top)
    return pairs.select(*columns, rank).unionByName(best)

"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with equal sets form one class;
the join works on classes. Each class has 128 minwise tokens. A tree branches by
selected tokens: a node chooses positions by its own hash, and a class goes to the
child named by its token at each position. Classes that are similar stay together
down some path of most trees; others part. Small nodes are compared exhaustively; large
ones meet a few pivots and branch again, or are compared in blocks as soon as all of
them together take a bounded number of comparisons for each class. Independent trees
are repeated until the chance to part a pair at the threshold is under the target: the
first ones suffice for the levels that branch twice; classes of nodes that went deeper get
further trees, by the depth that was reached.

Two classes that verified links already connect need no comparison, which is what
keeps groups of thousands of near copies linear: the pivots connect them, and only
members of different components are compared further. Links are confirmed on the
full sets; sketches only leave out pairs that are far below the threshold. Before any text
travels to a pair, parity bits of the two sets, a tenth of a text, leave out the pairs whose
sets certainly differ too much.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from chartweave.llm.components import connected_components
from chartweave.llm.shared import MAX_BROADCAST_KEYS, ROW_KEY, dropping, hinted, identified, located, restricted, write_batched, write_through
from chartweave.llm.word_sets import mixed, shingle_sets

POSITIONS = 128
BRANCHES = 2
#: Levels that branch twice; deeper ones, met only inside dense groups, branch once.
WIDE_LEVELS = 3
#: Nodes of up to so many classes are compared exhaustively.
LEAF = 512
#: In nodes of more classes than this, members first meet a pivot, so that a group of
#: near copies is linked by one comparison each.
PIVOT_FROM = 8
#: Pivots of a node, and every how many levels they are taken.
PIVOTS, PIVOT_EVERY = 3, 3
#: Larger nodes are compared exhaustively in blocks once that takes no more than so many
#: comparisons for each class of the table, and at any cost after so many levels.
COMPARISONS = 2_000
MAX_LEVELS = 10
#: Nodes of more classes than this are compared and confirmed block by block inside tasks;
#: pairs of smaller ones are rows of a join.
JOINED = 64
#: Classes of one block and their shingles, about; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Sets that a task keeps while it confirms pairs, in bytes; then it starts afresh.
KEPT_BYTES = 32 << 20
#: Packed texts, or parity bits, of up to so many bytes together (with ROW_BYTES a row) are broadcast
#: to their pairs; more are joined.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 64
#: Chance to find a pair at the threshold itself; more similar pairs have a higher one.
TARGET_RECALL = 0.9999
#: Deviations from the expected number of equal sketch tokens at which a pair is left out.
SKETCH_SIGMAS = 5.5

_RANDOM = np.random.default_rng(7)
_FACTORS = (_RANDOM.integers(0, 2**32, POSITIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _RANDOM.integers(0, 2**32, POSITIONS, dtype=np.uint32)[:, None]
_BITS = ["b0", "b1", "b2", "b3"]
#: What a class carries through the tree: its size, the place of one of its texts, its sketch.
_CARRIED = ["n", "__file", "__row", *_BITS]


def kept_by_tree(threshold: float, levels: int) -> float:
    """Chance that one tree of so many levels keeps a pair at the threshold together.

    What is left after a level that branches k times is 1 - (1 - threshold * q) ** k, if q is
    what the levels below it keep.
    """
    kept = 1.0
    for level in range(levels, 0, -1):
        kept = 1 - (1 - threshold * kept) ** (BRANCHES if level <= WIDE_LEVELS else 1)
    return kept


def tree_count(threshold: float, missed: float = 1 - TARGET_RECALL, levels: int = WIDE_LEVELS) -> int:
    """Trees of so many levels that all part a pair at the threshold with at most this chance.

    Up to WIDE_LEVELS the fixed point of the levels that branch twice bounds them all, so that the
    trees of shallow nodes leave most of the target to deeper ones.
    """
    kept = kept_by_tree(threshold, levels)
    if levels <= WIDE_LEVELS:
        for _ in range(200):
            kept = 1 - (1 - threshold * kept) ** BRANCHES
    return max(1, math.ceil(math.log(missed) / math.log(1 - kept)))


def more_trees(threshold: float, grown: list[tuple[int, int]]) -> int:
    """Trees that are still missing for the target, after some (trees, levels).

    The chance that the first trees part a pair before the deep levels counts too: such a
    pair may have no further trees.
    """
    early = (1 - kept_by_tree(threshold, WIDE_LEVELS)) ** grown[0][0]
    allowed = max(1 - TARGET_RECALL - early, (1 - TARGET_RECALL) / 2)
    missed = math.prod((1 - kept_by_tree(threshold, levels)) ** trees for trees, levels in grown)
    deepest = max(levels for _, levels in grown)
    if deepest <= WIDE_LEVELS or missed <= allowed:
        return 0
    return tree_count(threshold, allowed / missed, deepest)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of 128 hash functions over a set, as uint32."""
    low = (hashes >> np.uint64(17)).astype(np.uint32)
    best = np.full(POSITIONS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(best, (low[None, at : at + 4096] * _FACTORS + _SHIFTS).min(axis=1), out=best)
    return best


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, size, tokens, bits = [], [], [], []
            for h in shingle_sets(batch.column("text"), width):
                size.append(len(h))
                if not len(h):
                    cls.append(None)
                    tokens.append(np.zeros(POSITIONS, np.uint32))
                else:
                    cls.append(xxhash.xxh3_128_digest(h.tobytes()))
                    tokens.append(minwise(h))
            if not size:
                continue
            token = np.stack(tokens)
            pair = (mixed(token.astype(np.uint64)) & np.uint64(3)).reshape(len(size), 4, 32)
            bits = (pair << (2 * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
            flat = pa.array(token.view(np.int32).ravel())
            ends = pa.array(np.arange(0, flat.__len__() + 1, POSITIONS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names if c != "text"],
                    pa.array(cls, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(ends, flat),
                    *[pa.array(bits[:, j].copy()) for j in range(4)],
                ],
                names=[*[c for c in batch.schema.names if c != "text"], "cls", "n", "tokens", *_BITS],
            )

    return run


def _unequal(a: str, b: str) -> Column:
    """How many of the 128 two-bit sketch tokens differ."""
    def lanes(k: str) -> str:
        return f"({a}{k} ^ {b}{k})"

    return reduce(
        lambda x, y: x + y,
        [
            F.expr(f"bit_count(({lanes(k)} | shiftright({lanes(k)}, 1)) & 6148914691236517205L)")
            for k in _BITS
        ],
    )


def _most_unequal(threshold: float) -> int:
    equal = threshold + (1 - threshold) / 4
    spread = math.sqrt(POSITIONS * equal * (1 - equal))
    return math.ceil(POSITIONS * (1 - equal) + SKETCH_SIGMAS * spread)


def parity_bits(hashes: np.ndarray) -> bytes:
    """The places on which an odd number of a set's hashes fall, as bits.

    There are as many places as the power of two from twice the set's size on, 64 at least.
    """
    places = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    hits = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((hits & 1).astype(bool), bitorder="little").tobytes()


def _folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (in 64-bit words, last axis) over fewer places."""
    while parity.shape[-1] > words:
        half = parity.shape[-1] // 2
        parity = parity[..., :half] ^ parity[..., half:]
    return parity


def least_apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At least so many hashes are in one set but not in the other, by their parity bits.

    Common hashes cancel out, and each other one changes one bit at most.
    """
    words = min(one.shape[-1], others.shape[-1])
    return np.bitwise_count(_folded(one, words) ^ _folded(others, words)).sum(axis=-1, dtype=np.int64)


def _may_differ(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Two sets of these sizes together link if no more hashes are in one of them only."""
    return (100 - percent) * sizes // (100 + percent)


def _texts(width: int):
    """(cls, size, parity bits, packed text) of each text; the set can be made again from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text")
            cls, size, parity = [], [], []
            for h in shingle_sets(texts, width):
                cls.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                parity.append(parity_bits(h))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cls, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.array(parity, pa.binary()),
                    pa.array([squeeze((t.as_py() or "").encode()) for t in texts], pa.binary()),
                ],
                names=["cls", "size", "parity", "packed"],
            )

    return run


def _not_too_far(percent: int):
    """Pairs that may link by their parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size_u").to_numpy() + batch.column("size_v").to_numpy()
            ends = [[np.frombuffer(x, np.uint64) for x in batch.column(f"parity_{c}").to_pylist()] for c in "uv"]
            apart = np.array([least_apart(u, v) for u, v in zip(*ends, strict=True)], np.int64)
            keep = pa.array(apart <= _may_differ(sizes, percent))
            yield batch.select(["u", "v"]).filter(keep)

    return run


def _confirmed(width: int, percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor().decompress
        kept: dict[bytes, np.ndarray] = {}
        held = 0

        def of(cls: bytes, packed: pa.Scalar) -> np.ndarray:
            nonlocal held
            own = kept.get(cls)
            if own is None:
                text = loosen(packed.as_py()).decode()
                own = next(shingle_sets(pa.array([text], pa.large_string()), width))
                if held + own.nbytes > KEPT_BYTES:
                    kept.clear()
                    held = 0
                kept[cls] = own
                held += own.nbytes
            return own

        for batch in batches:
            left, right = batch.column("packed_u"), batch.column("packed_v")
            keys = zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)
            good = []
            for i, (u, v) in enumerate(keys):
                one, other = of(u, left[i]), of(v, right[i])
                both = np.intersect1d(one, other, assume_unique=True).size
                good.append(100 * both >= percent * (one.size + other.size - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"]
            )

    return run


class _Join:
    """What all steps of one join share."""

    def __init__(self, texts: DataFrame, classes: DataFrame, width: int, percent: int) -> None:
        self.texts, self.classes, self.width, self.percent = texts, classes, width, percent
        self.threshold = percent / 100
        self.limit = _most_unequal(self.threshold)

    def may_link(self, a: str, b: str) -> Column:
        near = (_unequal(a, b) <= self.limit) & (
            100 * F.least(F.col(f"{a}n"), F.col(f"{b}n"))
            >= self.percent * F.greatest(F.col(f"{a}n"), F.col(f"{b}n"))
        )
        return near

    def packed_texts(self, keys: DataFrame) -> DataFrame:
        """(cls, size, parity, packed) of the texts at these places, each once."""
        chosen = restricted(self.texts, keys, ROW_KEY).select("text")
        kind = "cls binary, size bigint, parity binary, packed binary"
        return write_batched(chosen.mapInArrow(_texts(self.width), kind), "texts")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs of classes, checked on full sets made from a text of each.

        ``pairs``: u, v, and the places of their texts. Their parity bits are compared first, so that
        texts travel only for pairs that may link.
        """
        pairs = write_through(pairs.distinct(), "pairs")
        keys = pairs.select(
            F.explode(
                F.array(*[F.struct(*[F.col(f"{side}{c}").alias(c) for c in ROW_KEY]) for side in "uv"])
            ).alias("k")
        ).select("k.*")
        texts = self.packed_texts(keys)
        may = _both_ends(pairs.select("u", "v"), texts, ["size", "parity"])
        near = write_batched(may.mapInArrow(_not_too_far(self.percent), "u binary, v binary"), "near-pairs")
        ends = near.select(F.explode(F.array("u", "v")).alias("cls"))
        sides = _both_ends(near, restricted(texts, ends, ["cls"]), ["packed"])
        return write_batched(
            sides.mapInArrow(_confirmed(self.width, self.percent), "u binary, v binary"), "confirmed"
        )


def _sized(table: DataFrame, column: str) -> DataFrame:
    """A table to be broadcast if this column has few bytes, as texts of a dense group have.

    Then no pair carries them in a shuffle.
    """
    size = table.agg(F.sum(F.octet_length(column) + ROW_BYTES)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _both_ends(pairs: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """u, v and these columns of both classes, the last of which is the large one."""
    texts = _sized(texts.select("cls", *columns), columns[-1])
    for side in "vu":
        own = texts.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, side)
    return pairs.select("u", "v", *[f"{c}_{side}" for c in columns for side in "uv"])


def _first_nodes(trees: range) -> Column:
    """The nodes of a class on the first level of these trees."""
    spots = [(t, b, (BRANCHES * t + b) * 37 % POSITIONS) for t in trees for b in range(BRANCHES)]
    nodes = [F.xxhash64(F.lit(t), F.lit(b), F.col("tokens")[p]) for t, b, p in spots]
    return F.array_distinct(F.array(*nodes))


def _first_rows(classes: DataFrame, trees: range, labels: DataFrame | None = None) -> DataFrame:
    nodes = F.explode(_first_nodes(trees)).alias("node")
    return _labelled(classes.select(nodes, "cls", *_CARRIED), labels)


def _next_rows(large: DataFrame, classes: DataFrame, labels: DataFrame | None, branches: int) -> DataFrame:
    spot = [F.pmod(F.xxhash64("node", F.lit(b)), F.lit(POSITIONS)).cast("int") for b in range(branches)]
    nodes = F.array(*[F.xxhash64("node", F.lit(b), F.col("tokens")[spot[b]]) for b in range(branches)])
    own = restricted(classes.select("cls", "tokens", *_CARRIED), large, ["cls"])
    rows = large.join(own, "cls").select(F.explode(nodes).alias("node"), "cls", *_CARRIED)
    return _labelled(rows, labels)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("cls"))
    own = hinted(labels).select(F.col("vertex").alias("cls"), F.col("label").alias("found"))
    return rows.join(own, "cls", "left").withColumn("label", F.coalesce("found", "cls")).drop("found")


def _open_rows(rows: DataFrame, first: bool) -> DataFrame:
    """Rows of nodes whose members lie in different components, with the size of the node.

    Nodes are counted first, by their hashes alone. Few of them have two members, so that the rows,
    with all that a class carries, mostly stay where they are or go no further.
    """
    members = F.count(F.lit(1)).alias("members")
    if first:  # every class is still a component
        nodes = rows.select("node").groupBy("node").agg(members).where("members > 1")
    else:
        ends = F.min("label").alias("low"), F.max("label").alias("high")
        nodes = rows.select("node", "label").groupBy("node").agg(members, *ends).where("low <> high")
    nodes = write_through(nodes.select("node", "members"), "open-nodes")
    return rows.join(hinted(nodes), "node").select("node", "members", "cls", "label", *_CARRIED)


def _pairs(near: DataFrame, one: str, other: str) -> DataFrame:
    """u, v and the places of their texts, from two groups of columns."""
    columns = [
        F.col(f"{prefix}{c}").alias(side if c == "cls" else f"{side}{c}")
        for side, prefix in (("u", one), ("v", other))
        for c in ("cls", *ROW_KEY)
    ]
    return near.select(*columns)


def _pivot_pairs(join: _Join, rows: DataFrame, level: int) -> DataFrame:
    """Members of each node that may link to one of its pivots; each level has other ones."""
    pivots = [
        F.min(F.struct(F.xxhash64(F.lit(level), F.lit(j), "cls").alias("rank"), "cls", "label", *_CARRIED))
        for j in range(PIVOTS)
    ]
    chosen = rows.groupBy("node").agg(F.array_distinct(F.array(*pivots)).alias("p"))
    chosen = chosen.select("node", F.explode("p").alias("p")).select(
        "node", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("cls", "label", *_CARRIED)]
    )
    near = rows.join(chosen, "node").where((F.col("label") != F.col("p_label")) & join.may_link("", "p_"))
    return _pairs(near, "p_", "")


def _leaf_pairs(join: _Join, rows: DataFrame) -> DataFrame:
    """Pairs of different components inside each node that may link."""
    rows = rows.select("node", "cls", "label", *_CARRIED)
    a = rows.select(*[F.col(c).alias(f"x_{c}" if c != "node" else c) for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"y_{c}" if c != "node" else c) for c in rows.columns])
    near = F.expr("x_cls < y_cls AND x_label <> y_label") & join.may_link("x_", "y_")
    return _pairs(a.join(b, (a["node"] == b["node"]) & near), "x_", "y_")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of nodes dealt to pairs of blocks: ``key`` names the pair, ``block`` the own block.

    The blocks of a node hold up to about BLOCK classes and BLOCK_SHINGLES shingles; they
    meet two by two, and a block meets itself once.
    """
    sizes = rows.groupBy("node").agg(F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    ends = F.least("block", "other"), F.greatest("block", "other")
    return (
        rows.join(sizes, "node")
        .select("node", "cls", "label", *_CARRIED, block.alias("block"), other)
        .select(F.xxhash64("node", *ends).alias("key"), "block", "cls", "label", *_CARRIED)
    )


def _rare_first(table: pa.Table) -> pa.Table:
    """The rows of a block pair, those of components with fewer classes here first."""
    label = _codes(table["label"]).to_numpy()
    return table.take(np.argsort(np.bincount(label)[label], kind="stable"))


def _near(table: pa.Table, limit: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each row and of the later ones that it may link to, in other components."""
    block, n, label = table["block"].to_numpy(), table["n"].to_numpy(), _codes(table["label"]).to_numpy()
    bits = np.stack([table[k].to_numpy().view(np.uint64) for k in _BITS], axis=1)
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    both = block.min() != block.max()
    for i in range(len(n) - 1):
        size = n[i + 1 :]
        good = (label[i + 1 :] != label[i]) & (100 * np.minimum(size, n[i]) >= percent * np.maximum(size, n[i]))
        if both:
            good &= block[i + 1 :] != block[i]
        later = np.flatnonzero(good) + i + 1
        apart = bits[later] ^ bits[i]
        unequal = np.bitwise_count((apart | (apart >> one)) & odd).sum(axis=1)
        yield i, later[unequal <= limit]


def _nearer(table: pa.Table, limit: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """The same, without those whose parity bits tell that they don't link."""
    n = table["n"].to_numpy()
    bits = [np.frombuffer(x.as_py(), np.uint64) for x in table["parity"]]
    words = np.array([len(x) for x in bits])
    # One matrix for each width; a row knows its place in it.
    stacked = {w: np.stack([x for x in bits if len(x) == w]) for w in set(words.tolist())}
    place = np.zeros(len(n), np.int64)
    for w, rows in stacked.items():
        place[words == w] = np.arange(len(rows))
    for i, later in _near(table, limit, percent):
        good = np.zeros(len(later), bool)
        for w in set(words[later].tolist()):
            own = np.flatnonzero(words[later] == w)
            apart = least_apart(bits[i], stacked[w][place[later[own]]])
            good[own] = apart <= _may_differ(n[i] + n[later[own]], percent)
        yield i, later[good]


def _codes(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks).dictionary_encode().indices


def _candidates(limit: int, percent: int, near=_near):
    """The rows of a block pair that may link to one of another component."""

    def run(table: pa.Table) -> pa.Table:
        found = np.zeros(len(table), bool)
        for i, later in near(table, limit, percent):
            found[later] = True
            found[i] |= len(later) > 0
        return table.filter(pa.array(found)).drop_columns([c for c in table.column_names if c == "parity"])

    return run


def _block_links(width: int, limit: int, percent: int):
    """Confirmed links of a block pair: as many as connect what its links connect."""

    def run(table: pa.Table) -> pa.Table:
        table = _rare_first(table)
        loosen = zstandard.ZstdDecompressor().decompress
        texts = (loosen(x.as_py()).decode() for x in table["packed"])
        sets = [next(shingle_sets(pa.array([t], pa.large_string()), width)) for t in texts]
        vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        group = _codes(table["label"]).to_numpy().copy()
        held = np.zeros(len(vocabulary), np.int64)
        links = []
        for i, own in _near(table, limit, percent):
            own = own[group[own] != group[i]]
            if not len(own):
                continue
            mine = ids[starts[i] : starts[i] + size[i]]
            held[mine] = 1
            ends = np.cumsum(size[own])
            spots = np.arange(ends[-1]) + np.repeat(starts[own] - ends + size[own], size[own])
            common = np.add.reduceat(held[ids[spots]], ends - size[own])
            held[mine] = 0
            for j in own[100 * common >= percent * (size[i] + size[own] - common)].tolist():
                if group[i] != group[j]:
                    links.append((i, j))
                    group[group == group[j]] = group[i]
        u, v = (np.array([link[k] for link in links], np.int64) for k in (0, 1))
        names = pa.concat_arrays(table["cls"].chunks)
        return pa.table({"u": names.take(pa.array(u)), "v": names.take(pa.array(v))})

    return run


def _wide_links(join: _Join, rows: DataFrame) -> DataFrame:
    """Links of different components inside large nodes.

    The pairs of a dense group that just miss the threshold never become rows: one pass
    over the sketches leaves the classes that may link in a block pair, a second one has their parity
    bits and leaves fewer, a third one has the texts of those and confirms them.
    """
    dealt = _blocks(rows)
    kept = dealt.groupBy("key").applyInArrow(_candidates(join.limit, join.percent), dealt.schema)
    kept = write_through(kept, "candidates")
    texts = join.packed_texts(kept.select(*ROW_KEY))
    parities = kept.join(_sized(texts.select("cls", "parity"), "parity"), "cls").select(*dealt.columns, "parity")
    fewer = parities.groupBy("key").applyInArrow(_candidates(join.limit, join.percent, _nearer), dealt.schema)
    fewer = write_through(fewer, "near-candidates")
    packed = _sized(restricted(texts, fewer, ["cls"]).select("cls", "packed"), "packed")
    sides = fewer.join(packed, "cls").select(*dealt.columns, "packed")
    links = sides.groupBy("key").applyInArrow(
        _block_links(join.width, join.limit, join.percent), "u binary, v binary"
    )
    return write_through(links, "wide-links")


def similar_classes(
    texts: DataFrame, classes: DataFrame, width: int, percent: int, leaf: int = LEAF, levels: int = MAX_LEVELS
) -> DataFrame:
    """(vertex, label) of all classes that have a link; see the module's text."""
    join = _Join(texts, classes, width, percent)
    affordable = COMPARISONS * classes.count()
    links: list[DataFrame] = []
    grown: list[tuple[int, int]] = []
    members, labels, trees = classes, None, tree_count(join.threshold)
    while trees:
        first = sum(t for t, _ in grown)
        rows = _first_rows(members, range(first, first + trees), labels)
        depth, labels, leaves, deep = _grow(join, classes, rows, labels, links, affordable, leaf, levels)
        rest = _labelled(reduce(DataFrame.unionByName, leaves).drop("label"), labels)
        joined = min(JOINED, leaf)
        links.append(join.confirm(_leaf_pairs(join, rest.where(F.col("members") <= joined))))
        links.append(_wide_links(join, rest.where(F.col("members") > joined)))
        found = connected_components(reduce(DataFrame.unionByName, links))
        grown.append((trees, depth))
        trees = more_trees(join.threshold, grown)
        if trees:
            # Only pairs that met in a node below the wide levels may need further trees.
            if len(grown) == 1:
                members = write_through(restricted(classes, deep, ["cls"]), "deep-classes")
            labels = write_through(found, "labels")
    return found


def _grow(
    join: _Join,
    classes: DataFrame,
    rows: DataFrame,
    labels: DataFrame | None,
    links: list[DataFrame],
    affordable: int,
    leaf: int,
    levels: int,
) -> tuple[int, DataFrame, list[DataFrame], DataFrame | None]:
    """Branches some trees to their leaves: levels, components, leaves, and the classes below WIDE_LEVELS.

    Links of pivots are added to ``links``.
    """
    leaves, deep, fresh = [], None, labels is None
    for level in range(1, levels + 1):
        met = write_through(_open_rows(rows, fresh and level == 1), "nodes")
        large = met.where(F.col("members") > leaf)
        # Every row of a node meets each other one: half its members, on average.
        comparisons = (large.agg(F.sum("members")).first()[0] or 0) // 2
        last = level == levels or comparisons <= affordable
        leaves.append(met if last else met.where(F.col("members") <= leaf))
        if (level - 1) % PIVOT_EVERY == 0:
            crowded = met.where(F.col("members") > PIVOT_FROM)
            links.append(join.confirm(_pivot_pairs(join, crowded, level)))
            labels = write_through(connected_components(reduce(DataFrame.unionByName, links)), "labels")
        if last:
            break
        if level == WIDE_LEVELS:
            deep = large.select("cls")
        branches = BRANCHES if level < WIDE_LEVELS else 1
        rows = _next_rows(large.select("node", "cls"), classes, labels, branches)
    return level, labels, leaves, deep


def _class_rows(sketched: DataFrame) -> DataFrame:
    """One row of each class, the first by place: cls, n, place, tokens, sketch.

    Only hashes and places are grouped. The tokens, most of a row's bytes, are read where they were
    written; beyond the classes that a broadcast holds they are written once more instead.
    """
    place = F.min(F.struct(*ROW_KEY)).alias("place")
    heads = sketched.where("cls IS NOT NULL").select("cls", *ROW_KEY).groupBy("cls").agg(place)
    heads = write_through(heads.select("place.*"), "class-places")
    columns = ["cls", "n", *ROW_KEY, "tokens", *_BITS]
    if heads.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        return sketched.join(F.broadcast(heads), ROW_KEY, "left_semi").select(*columns)
    return write_through(sketched.join(heads, ROW_KEY, "left_semi").select(*columns), "classes")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: __file, __row, doc_id, n_shingles, component_id, leader.

    component_id is the smallest id in the component (null ids only count if there is no
    other), ``leader`` is true for exactly one row of each component: the smallest by
    (id, place in the files). Texts without words are components of their own, with
    their own id. Repeated rows, equal sets and null ids are ordinary members. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = identified(docs)
    rows = rows.select(
        "__file", "__row", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].cast("string").alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    sketched = write_batched(
        rows.mapInArrow(
            _sketches(width),
            f"__file bigint, __row bigint, doc_id {kind}, cls binary, n bigint, "
            "tokens array<int>, b0 bigint, b1 bigint, b2 bigint, b3 bigint",
        ),
        "sketches",
    )
    classes = _class_rows(sketched)
    texts = rows.select(*ROW_KEY, "text")
    labels = write_through(similar_classes(texts, classes, width, percent), "components")
    facts = (
        sketched.select("__file", "__row", "doc_id", "n", "cls")
        .join(labels.select(F.col("vertex").alias("cls"), "label"), "cls", "left")
        .withColumn("label", F.coalesce("label", "cls"))
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("best")
    tops = facts.where("label IS NOT NULL").groupBy("label").agg(least)
    return facts.join(tops, "label", "left").select(
        "__file",
        "__row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.coalesce(
            (F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row")), F.lit(True)
        ).alias("leader"),
    )


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` without the rows that aren't leaders; same columns, any extra ones included."""
    docs = located(docs)
    rows = identified(docs)
    found = near_duplicates(docs, text, doc_id, width, percent)
    dropped = found.where(~F.col("leader")).select("__file", "__row")
    return dropping(rows, dropped, ROW_KEY).select("row.*")

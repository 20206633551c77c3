"""Substring dedup: passages that repeat across documents, by Rabin-Karp window hashes.

Every window of a fixed number of words has a rolling hash. A window is named by its
minimiser, the least hash of its shingles of half as many words; equal windows have equal
minimisers, and neighbours mostly share one. So windows are counted in Spark run by run:

1. A run is a maximal row of neighbouring windows with one minimiser, hashed as a whole.
   Runs whose minimiser occurs in one document alone can't hold a repeat.
2. Equal runs form a class. All windows of its members repeat those of the smallest document.
3. Only where different classes share a minimiser are the single windows of their smallest
   members hashed and counted.

The repeats merge into maximal intervals of words for each document. Window hashes have 96
bits. A text travels only if it has windows to hash in step 3; counts, runs and intervals do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartweave.llm.shared import MAX_BROADCAST_KEYS, ROW_KEY, hinted, identified, located, restricted, write_through
from chartweave.llm.word_sets import buffers, mixed, slices, word_bounds

WINDOW = 50
#: A key that has more rows than this share of all is joined by broadcast; at most 1 / share exist.
HEAVY_SHARE, HEAVY_ROWS = 1e-5, 10_000

_BYTE = np.random.default_rng(20260712).integers(1, 2**64, 256, dtype=np.uint64)
_BASES = {"bytes": 0x9E3779B97F4A7C15, "one": 0xC2B2AE3D27D4EB4F, "other": 0xD6E8FEB86659FD93}
_APART = np.uint64(0x5851F42D4C957F2D)
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64; kept between calls."""
    up, down = _POWERS.get(kind, (np.empty(0, np.uint64),) * 2)
    if len(up) < n:
        base = _BASES[kind]
        up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[kind] = up, down
    return up[:n], down[:n]


class Rolling:
    """Rabin-Karp hashes of any stretches of one sequence, from prefix sums."""

    def __init__(self, values: np.ndarray, kind: str) -> None:
        up, self.down = _powers(kind, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[begins]) * self.down[begins]


class _Words:
    """The words of some texts, and 64 + 32 bits of hash of any stretch of them."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        begins, ends, self.counts = word_bounds(data, starts)
        size = (ends - begins).astype(np.uint64)
        words = mixed(Rolling(_BYTE[data], "bytes").of(begins, ends) + size) if len(begins) else size
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.one, self.other = Rolling(words, "one"), Rolling(mixed(words ^ _APART), "other")

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = mixed(self.other.of(begins, ends)) >> np.uint64(32)
        return mixed(self.one.of(begins, ends)).view(np.int64), low.astype(np.uint32).view(np.int32)

    def runs(self, window: int) -> tuple[np.ndarray, ...]:
        """Text, minimiser, first window and number of windows of each run."""
        total, texts = int(self.first[-1]), np.repeat(np.arange(len(self.counts)), self.counts)
        starts = np.flatnonzero(np.arange(window, total + window) <= np.repeat(self.first[1:], self.counts))
        if not len(starts):
            return (np.empty(0, np.int64),) * 4
        inner = (window + 1) // 2
        at = np.arange(total - inner + 1)
        least = _sliding_min(mixed(self.one.of(at, at + inner)), window - inner + 1)[starts]
        own = texts[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        heads = np.flatnonzero(new)
        return own[heads], least[heads].view(np.int64), starts[heads], np.diff(np.append(heads, len(starts)))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in slices of about a megabyte of text: rows, bytes and where texts start."""
    texts = batch.column("text")
    data, starts = buffers(texts.fill_null("") if texts.null_count else texts)
    for first, last in slices(data, starts):
        part = data[starts[first] : starts[last]]
        yield batch.slice(first, last - first), part, starts[first : last + 1] - starts[first]


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _run_rows(window: int):
    """Each text's number of words and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in _parts(batch):
                words = _Words(data, starts)
                text, least, at, n = words.runs(window)
                h, g = words.hashes(at, at + n + window - 1)
                counts = np.bincount(text, minlength=len(words.counts))
                lists = [
                    _lists(counts, least, pa.int64()),
                    _lists(counts, h, pa.int64()),
                    _lists(counts, g, pa.int32()),
                    _lists(counts, at - words.first[text], pa.int32()),
                    _lists(counts, n, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in (*ROW_KEY, "doc_id")], *lists],
                    names=[*ROW_KEY, "doc_id", "least", "h", "g", "at", "n"],
                )

    return run


def _window_rows(window: int):
    """The single windows of marked runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in _parts(batch):
                words = _Words(data, starts)
                marked = rows.column("runs")
                flat, row = marked.flatten(), np.repeat(np.arange(len(marked)), marked.value_lengths())
                at, n = (flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("at", "n"))
                ends = np.cumsum(n)
                within = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
                own, local = np.repeat(row, n), np.repeat(at, n) + within
                spots = words.first[own] + local
                h, g = words.hashes(spots, spots + window)
                keys = [rows.column(c).take(pa.array(own)) for c in (*ROW_KEY, "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(local, pa.int32()), pa.array(h), pa.array(g)],
                    names=[*ROW_KEY, "doc_id", "at", "h", "g"],
                )

    return run


def _merged(window: int):
    """Runs of repeated windows as maximal intervals [start, end) of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for spans in batch.column("spans"):
                low, high = [], []
                for at, n in sorted((s["at"], s["n"]) for s in spans.as_py()):
                    if high and at <= high[-1]:
                        high[-1] = max(high[-1], at + n + window - 1)
                    else:
                        low.append(at)
                        high.append(at + n + window - 1)
                starts.append(low)
                ends.append(high)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ROW_KEY], *[pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]],
                names=[*ROW_KEY, "starts", "ends"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, its words joined by one space."""
    for batch in batches:
        counts, removed, kept = [], [], []
        spans = zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)
        for text, (starts, ends) in zip(batch.column("text"), spans, strict=True):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            gone = 0
            for start, end in zip(reversed(starts or []), reversed(ends or []), strict=True):
                del words[start:end]
                gone += end - start
            removed.append(gone)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in (*ROW_KEY, "doc_id")],
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                batch.column("starts"),
                batch.column("ends"),
                pa.array(kept, pa.string()),
            ],
            names=[*ROW_KEY, "doc_id", "n_words", "n_removed", "starts", "ends", "kept_text"],
        )


def _joined(rows: DataFrame, classes: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` with the one row of ``classes`` (which counts its ``members``) that has their key.

    Keys with a large share of all rows are few by arithmetic, so they are broadcast, and their
    rows don't travel; the rest can't crowd one task.
    """
    limit = max(HEAVY_ROWS, int(total * HEAVY_SHARE))
    facts = [c for c in classes.columns if c not in (*on, "members")]
    heavy = classes.where(F.col("members") > limit).select(*on, F.struct(*facts).alias("__heavy"))
    light = classes.where(F.col("members") <= limit).drop("members")
    marked = rows.join(F.broadcast(heavy), on, "left")
    hot = marked.where("__heavy IS NOT NULL").select(*rows.columns, "__heavy.*")
    rest = marked.where("__heavy IS NULL").drop("__heavy").join(light, on)
    return hot.unionByName(rest.select(*rows.columns, *facts))


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """(__file, __row, starts, ends) of the rows that lose words; ``rows`` as in remove_repeats."""
    kind = dict(rows.dtypes)["doc_id"]
    keys = f"__file bigint, __row bigint, doc_id {kind}"
    lists = "least array<bigint>, h array<bigint>, g array<int>, at array<int>, n array<int>"
    stored = write_through(rows.mapInArrow(_run_rows(window), f"{keys}, {lists}"), "runs")
    runs = stored.where("doc_id IS NOT NULL").select(
        *ROW_KEY, "doc_id", F.explode(F.arrays_zip("least", "h", "g", "at", "n")).alias("run")
    )
    runs = runs.select(*ROW_KEY, "doc_id", "run.*")
    ends = F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    shared = write_through(runs.groupBy("least").agg(*ends).where("low < high").select("least"), "minimisers")
    runs = write_through(runs.join(hinted(shared), "least", "left_semi"), "shared-runs")
    total = runs.count()

    same = ["least", "h", "g", "n"]
    first = F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("members")
    classes = write_through(runs.groupBy(*same).agg(*first), "run-classes")
    kinds = classes.groupBy("least").agg(F.count(F.lit(1)).alias("kinds"), F.sum("members").alias("members"))
    kinds = write_through(kinds, "kinds")
    known = write_through(_joined(runs, classes, same, total), "known-runs")
    copies = known.where("doc_id > low").select(*ROW_KEY, "at", "n")

    # Different runs with one minimiser may still share windows: those of the smallest members decide.
    firsts = known.where("doc_id = low").select(*ROW_KEY, "doc_id", "least", "at", "n")
    firsts = _joined(firsts, kinds.where("kinds > 1"), ["least"], total)
    marks = firsts.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    marks = write_through(marks, "marked")
    texts = restricted(rows, marks, ROW_KEY).join(marks, ROW_KEY)
    windows = texts.mapInArrow(_window_rows(window), f"{keys}, at int, h bigint, g int")
    windows = write_through(windows, "windows")
    counted = windows.groupBy("h", "g").agg(*first).where("members > 1")
    counted = write_through(counted, "window-counts")
    again = _joined(windows, counted, ["h", "g"], windows.count()).where("doc_id > low")
    spans = copies.unionByName(again.select(*ROW_KEY, "at", F.lit(1).alias("n")))
    spans = spans.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return write_through(
        spans.mapInArrow(_merged(window), "__file bigint, __row bigint, starts array<int>, ends array<int>"), "spans"
    )


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: __file, __row, doc_id, n_words, n_removed, starts, ends, kept_text.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged. A word goes if a
    window of ``window`` words covers it whose words also start somewhere in a document with a
    smaller id; windows are judged on the input. [start, end) are the maximal intervals of
    words that go (null if none), kept_text the rest joined by single spaces.

    Null and empty texts, and those shorter than a window, lose nothing. Rows that share an id
    are no reason to cut each other, but each is cut by smaller ids. Rows without an id neither lose
    words nor make others lose them. An empty table gives an empty result; other columns are
    ignored. A text is held whole by one task, however long.
    """
    rows = identified(located(docs)).select(
        *ROW_KEY, F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].cast("string").alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    spans = _spans(rows, window)
    size = spans.agg(F.sum(F.size("starts") + 2)).first()[0] or 0
    spans = F.broadcast(spans) if size <= MAX_BROADCAST_KEYS else spans
    return rows.join(spans, ROW_KEY, "left").mapInArrow(
        _cut,
        f"__file bigint, __row bigint, doc_id {kind}, n_words bigint, n_removed bigint, "
        "starts array<int>, ends array<int>, kept_text string",
    )

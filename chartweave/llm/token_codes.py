"""Token ids as directly addressable codes.

File format: Parquet rows of independent blocks, in ascending order of (part, block).
A block holds whole documents in ascending id order:

    payload   magic b"DAC1", uint32 levels, then per level: uint64 entries, the entries as
              bytes (low eight bits first), the continuation bits (little bit order, padded
              to eight bytes) and a rank directory: uint32 ones before every 512 bits
    doc_ids, lengths   the documents of the block and their numbers of ids

Level k keeps byte k of the ids that have one; its bit says that the id goes on. The
place of an id in the next level is the rank of its bit, so any id is read from a
few places without decoding anything before it.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chartweave.llm.shared import fresh_path, hinted, packed, short_batches, write_batched, write_through
from chartweave.llm.word_sets import buffers, slices, word_bounds

END_ID = 1
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Texts of about so many bytes go to one part.
PART_BYTES = 32 << 20
#: Texts whose words are found together, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Texts whose distinct words are looked up together, in bytes; a longer batch is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Distinct words and their ids that a worker keeps, in bytes; then it starts afresh.
KEPT_BYTES = 12 << 20
#: Words of a line for the tokenizer, and of one call of it.
LINE_WORDS, CALL_WORDS = 256, 2_048
#: Signs to part words in a line; the first that is a single id is taken.
MARKS = "\u00a6\u00b6\u00a7|~^"
_RANK_BITS = 512

#: A tokenizer that begins with these steps also ends a word between an ASCII letter, digit or sign and
#: another kind of them, but for a letter after an apostrophe; it lowers ASCII letters.
_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Kinds of bytes: 0 control signs and parts of other characters, 1 letters, 2 digits, 3 other signs, 4 apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27] = 4
_CUT = np.zeros((5, 5), bool)
_CUT[1, 2:] = _CUT[2, [1, 3, 4]] = _CUT[3, 1:3] = _CUT[4, 2] = True


def encode_block(ids: np.ndarray) -> bytes:
    """The payload of a sequence of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % 8, np.uint8)))
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), _RANK_BITS // 8)) if len(bits) else bits
        ranks = np.concatenate(([0], np.cumsum(ones, dtype=np.uint64)[:-1])) if len(bits) else ones
        levels.append((len(rest), (rest & 255).astype(np.uint8), bits, ranks.astype("<u4")))
        rest = rest[more] >> 8
    out = [b"DAC1", struct.pack("<I", len(levels))]
    for n, low, bits, ranks in levels:
        out += [struct.pack("<Q", n), low.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Block:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != b"DAC1":
            raise ValueError("not a block of token ids")
        (count,) = struct.unpack_from("<I", payload, 4)
        at, self._levels = 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", payload, at)
            wide = (n + 63) // 64 * 8
            ranks = (wide * 8 + _RANK_BITS - 1) // _RANK_BITS
            at += 8
            low = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, "<u8", wide // 8, at + n) if (at + n) % 8 == 0 else np.frombuffer(
                payload[at + n : at + n + wide], "<u8"
            )
            self._levels.append((low, bits, np.frombuffer(payload, "<u4", ranks, at + n + wide)))
            at += n + wide + 4 * ranks

    def __len__(self) -> int:
        return len(self._levels[0][0])

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places of the block."""
        places = np.asarray(places, np.int64)
        out, open_, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for low, bits, ranks in self._levels:
            out[open_] |= low[places].astype(np.uint32) << np.uint32(shift)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            on = (bits[word] >> bit) & np.uint64(1) == 1
            if not on.any():
                break
            open_, places, word, bit = open_[on], places[on], word[on], bit[on]
            # Ones before the place: directory, then whole words, then bits of its own word.
            before = ranks[places // _RANK_BITS].astype(np.int64)
            first = places // _RANK_BITS * (_RANK_BITS // 64)
            if len(places) > len(bits):  # many places: each word is counted once
                ones = np.zeros((len(ranks), _RANK_BITS // 64), np.int64)
                ones.ravel()[: len(bits)] = np.bitwise_count(bits)
                before += (np.cumsum(ones, axis=1) - ones).ravel()[word]
            else:
                for k in range(_RANK_BITS // 64 - 1):
                    inner = first + k
                    use = inner < word
                    before[use] += np.bitwise_count(bits[inner[use]])
            before += np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            places, shift = before, shift + 8
        return out


@cache
def _tokenizer(path: str):
    """The tokenizer of a worker: loaded once, not by each task anew."""
    # A task has one core; the library's own threads would take those of others, and memory each.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _joined(ids: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some entries one after another, and where each entry's end, after a 0."""
    starts, sizes = ends[places], ends[places + 1] - ends[places]
    stops = np.concatenate(([0], np.cumsum(sizes)))
    return ids[np.repeat(starts - stops[:-1], sizes) + np.arange(stops[-1])], stops


class WordEncoder:
    """Ids of texts, each distinct run of non-space characters being encoded once.

    White space always ends a word for the tokenizer, so the ids of a text are those of its
    runs one after another; if it has the known steps, runs are made of shorter pieces that
    many of them share. Pieces and their ids are kept in flat arrays, up to KEPT_BYTES.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = _tokenizer(path)
        alone = {mark: self._tokenizer.encode(mark, add_special_tokens=False).ids for mark in MARKS}
        self._mark, self._mark_id = next(((m, x[0]) for m, x in alone.items() if len(x) == 1), (None, None))
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [x.content.encode().lower() for x in added]
        steps = {name: getattr(self._tokenizer, name) for name in _STEPS}
        self._pieced = {name: x and json.loads(x.__getstate__()) for name, x in steps.items()} == _STEPS
        self._pieced &= all(x.content.isascii() and not x.normalized for x in added)
        self._between = pa.scalar(f" {self._mark} ", pa.large_string())
        self._clear()

    def _clear(self) -> None:
        self._kept = pa.array([], pa.large_binary())
        self._kept_ids, self._ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self._last = np.empty(0, np.int64)

    def _kept_bytes(self) -> int:
        return self._kept.nbytes + self._kept_ids.nbytes + self._ends.nbytes

    def _shorten(self) -> None:
        """Keeps what the last call used, or nothing if that is much."""
        last, self._last = self._last, np.arange(len(self._last))
        self._kept_ids, self._ends = _joined(self._kept_ids, self._ends, last)
        self._kept = self._kept.take(pa.array(last))
        if self._kept_bytes() > KEPT_BYTES // 2:
            self._clear()

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among the kept ones; new words are encoded and kept."""
        if self._kept_bytes() > KEPT_BYTES:
            self._shorten()
        place = pc.index_in(words, value_set=self._kept)
        fresh = place.is_null()
        new, place = words.filter(fresh), place.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            ids, sizes = self._words(new)
            place[fresh.to_numpy(zero_copy_only=False)] = np.arange(len(new)) + len(self._kept)
            ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(sizes)))
            # All at once: the worker's next task takes them as they are.
            self._kept, self._kept_ids, self._ends = (
                pa.concat_arrays([self._kept, new]),
                np.concatenate((self._kept_ids, ids)),
                ends,
            )
        self._last = place
        return place

    def _pieces(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of words as places among the distinct ones, and how many each word has.

        A letter before other than ASCII stays as it is: together they may be one character.
        """
        data, starts = buffers(words)
        kind = _KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1], kind[1:]]
        cut[starts] = True
        lower = (data - 0x41 < 26) & (cut[1:] | np.append(data[1:] < 0x80, True))
        data = data + (lower.view(np.uint8) << 5)
        every = data.tobytes().lower()
        if any(x in every for x in self._added):  # the library finds it before it lowers and cuts
            return words.dictionary_encode(), np.ones(len(words), np.int64)
        bounds = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        )
        return pieces.dictionary_encode(), np.diff(np.searchsorted(bounds, starts))

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words in order, and where those of each word end, after a 0."""
        if not (self._pieced and len(words)):
            place = self._places(words)
            return _joined(self._kept_ids, self._ends, place)
        pieces, counts = self._pieces(words)
        place = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, ends = _joined(self._kept_ids, self._ends, place)
        return ids, ends[np.concatenate(([0], np.cumsum(counts)))]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, and the number of ids of each.

        The library takes words faster in lines, with a mark of one id between two. A line with
        more of these ids than marks holds the mark in a word, and its words are encoded one by one.
        """
        words = words.cast(pa.large_string())
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), CALL_WORDS):
            call = words[at : at + CALL_WORDS]
            cuts = [*range(0, len(call), LINE_WORDS), len(call)]
            lines = pc.binary_join(pa.ListArray.from_arrays(cuts, call), self._between).to_pylist()
            found = self._ids(lines) if self._mark else lines
            for first, last, own in zip(cuts, cuts[1:], found, strict=False):
                if self._mark:
                    own = np.array(own, np.uint32)
                    marks = own == self._mark_id
                    ends = np.append(np.flatnonzero(marks), len(own))
                    if len(ends) == last - first:
                        ids.append(own[~marks])
                        sizes.append(np.diff(ends, prepend=-1) - 1)
                        continue
                single = self._ids(call[first:last].to_pylist())
                sizes.append(np.array([len(x) for x in single], np.int64))
                ids.append(np.fromiter((i for x in single for i in x), np.uint32))
        return np.concatenate(ids), np.concatenate(sizes)

    @staticmethod
    def _found(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of a slice as places among its distinct ones, and how many each text has."""
        data, starts = buffers(texts)
        begins, ends, counts = word_bounds(data, starts)
        if not len(begins):
            return pa.array([], pa.large_binary()).dictionary_encode(), counts
        # Words and the gaps between them by turns, so that Arrow finds equal words where they lie.
        bounds = np.stack((begins, ends), axis=1).ravel()
        turns = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        )
        return turns.take(pa.array(np.arange(0, len(turns), 2))).dictionary_encode(), counts

    def encoded(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts all ids in order, and the number of ids of each text.

        The distinct words of all slices are looked up once, not by each slice among all kept ones.
        """
        found = [
            self._found(texts[first:last])
            for texts in columns
            for first, last in slices(*buffers(texts), SLICE_BYTES)
        ]
        if not found:
            return
        words = pa.concat_arrays([own.dictionary for own, _ in found]).dictionary_encode()
        word_ids, word_ends = self._word_ids(words.dictionary)
        place, at = words.indices.to_numpy(), 0
        for own, counts in found:
            here = place[at : at + len(own.dictionary)][own.indices.to_numpy()]
            at += len(own.dictionary)
            out, stops = _joined(word_ids, word_ends, here)
            yield out, np.diff(stops[np.concatenate(([0], np.cumsum(counts)))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        parts = list(self.encoded([texts])) or [(np.empty(0, np.uint32), np.zeros(0, np.int64))]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])


@cache
def _encoder(path: str) -> WordEncoder:
    """The encoder of a worker: its tasks go on with the words of those before."""
    return WordEncoder(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches side by side, of about CHUNK_BYTES of text together."""
    held, size = [], 0
    for batch in batches:
        own = batch.column("text").nbytes
        if held and size + own > CHUNK_BYTES:
            yield held
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += own
    if held:
        yield held


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, part = _encoder(path), 0, None
        docs, lengths, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal block, docs, lengths, ids, held
            row = pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part,
                        "block": block,
                        "n_ids": held,
                        "doc_ids": docs,
                        "lengths": lengths,
                        "payload": encode_block(np.concatenate(ids)),
                    }
                ],
                schema=_BLOCK_ARROW,
            )
            block, docs, lengths, ids, held = block + 1, [], [], [], 0
            return row

        for chunk in _chunks(batches):
            part = chunk[0].column("part")[0].as_py()
            keys = iter([key for batch in chunk for key in batch.column("doc_id").to_pylist()])
            pa.default_memory_pool().release_unused()
            for flat, sizes in encoder.encoded([batch.column("text").fill_null("") for batch in chunk]):
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                at = 0
                for size in (sizes + 1).tolist():
                    if held and held + size > BLOCK_IDS:
                        yield closed()
                    docs.append(next(keys))
                    lengths.append(size)
                    ids.append(flat[at : at + size])
                    at += size
                    held += size
        if docs:
            yield closed()

    return run


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
_BLOCK = "part int, block bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write_token_codes(
    docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID
) -> None:
    """Encode every whole text and write the ids under ``path`` in ascending id order.

    Null texts count as empty and give the end id alone. Null ids come first; rows with
    one id lie side by side, in the order of their texts. Other columns are ignored. An
    empty table writes no block. ``doc_id`` must be a whole number.
    """
    rows = packed(docs).select(
        F.col("row")[doc_id].cast("long").alias("doc_id"), F.col("row")[text].cast("string").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        _encoded(tokenizer, end_id), _BLOCK
    )
    with short_batches(docs.sparkSession):
        blocks.write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the number of ids in all blocks before.

    Starts are sums of two small tables: ids by part, and blocks inside their own part.
    """
    blocks = spark.read.schema(_BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select(
        "part",
        (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"),
    )
    inside = Window.partitionBy("part").orderBy("block")
    starts = (
        blocks.select("part", "block", "n_ids")
        .withColumn("inner", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(before, "part")
        .select("part", "block", (F.col("base") + F.col("inner")).alias("start"))
    )
    # One short row a block: counted, and broadcast if few, so that payloads needn't move.
    return blocks.join(hinted(write_through(starts, "block-starts")), ["part", "block"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            block = Block(row["payload"])
            starts, crcs, at = [], [], 0
            ids = block.ids(np.arange(len(block)))
            for n in row["lengths"]:
                starts.append(row["start"] + at)
                crcs.append(zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
                at += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def document_digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files' blocks."""
    return blocks.select("start", "doc_ids", "lengths", "payload").mapInArrow(
        _digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_codes(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and digest them from the files."""
    path = fresh_path(docs.sparkSession, "token-codes")
    write_token_codes(docs, path, tokenizer)
    return write_batched(document_digests(read_blocks(docs.sparkSession, path)), "token-digests")

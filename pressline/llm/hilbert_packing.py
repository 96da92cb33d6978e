"""Packing (10): documents in the order of a space-filling curve, cut into full sequences.

Every word is hashed to a sign per dimension; a document's vector is the mean of its words,
a projection of its bag of words to a few dimensions. The Hilbert key of the quantised vector
puts similar documents next to each other. Documents are range-sorted by that key and laid
end to end along the curve; every 2048 ids make a sequence. The ids that are left at the end
of a partition go into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pressline.llm.textarrays import mix, sequence_hashes, slices, split_words, word_hashes
from pressline.llm.word_bpe import forget, load

LENGTH = 2048
END = 1  # the id that closes every document
DIMENSIONS = 4
BITS = 10
TIE_BITS = 22
SAMPLE = 16
SPREAD = 0.5  # means beyond this are rare; the grid covers -SPREAD … SPREAD


def projections(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vector of every row in ``DIMENSIONS`` dimensions, and a hash of its words."""
    words = split_words(column)
    hashes = word_hashes(words)
    count = words.counts
    sums = np.zeros((len(count), DIMENSIONS))
    for d in range(DIMENSIONS):
        sign = ((hashes >> np.uint64(13 * d + 5)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(sign)])
        sums[:, d] = total[words.bounds[1:]] - total[words.bounds[:-1]]
    return sums / np.maximum(count, 1)[:, None], sequence_hashes(hashes, words.bounds[:-1], words.bounds[1:])


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of every grid point on the Hilbert curve through ``2**bits`` cells per dimension.

    The coordinates are turned into the curve's transposed index by undoing, from the highest
    bit down, the reflections and swaps of each level; a Gray code decodes the result.
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] ^= np.where(flip, 0, swap) if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros(grid.shape[0], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def curve_keys(column: pa.Array, tie: np.ndarray) -> np.ndarray:
    """The sort key of every row: its Hilbert key, then a hash that parts equal places."""
    vectors, content = projections(column)
    cells = 1 << BITS
    grid = np.clip(((vectors / SPREAD + 1) / 2 * cells).astype(np.int64), 0, cells - 1)
    parted = mix(content ^ mix(tie.astype(np.uint64))) >> np.uint64(64 - TIE_BITS)
    return (hilbert_keys(grid) << TIE_BITS) | parted.astype(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in slices(batch):
            yield part, curve_keys(part.column("text"), part.column("_tie").to_numpy(zero_copy_only=False))


def _key_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, keys in _keyed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["curve_key"])


def _placed(bounds: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys in _keyed(batches):
            ids = pa.array(np.searchsorted(bounds, keys).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(keys), ids], names=["doc_id", "text", "curve_key", "part"])

    return place


def sort_along_curve(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` range-sorted by curve key, one stretch of the curve per partition.

    The bounds of the stretches are quantiles of the keys of one document in ``SAMPLE``; they
    only balance the partitions.
    """
    named = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id").alias("_tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = named.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(SAMPLE)) == 0)
    shares = [k / parts for k in range(1, parts)]
    bounds = np.array(some.mapInArrow(_key_only, "curve_key long").approxQuantile("curve_key", shares, 0.1 / parts) if shares else [], np.float64)
    keyed = named.mapInArrow(_placed(bounds), "doc_id long, text string, curve_key long, part int")
    return keyed.repartitionById(parts, "part").sortWithinPartitions("curve_key", "doc_id").select("doc_id", "text")


class _Packer:
    """Cuts a stream of documents into pieces of full sequences."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.used = 0
        self.open: list[tuple] = []  # pieces of the sequence that is being filled
        self.rows: list[tuple] = []

    def _close(self) -> None:
        self.rows += self.open
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def add(self, doc, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(total - start, self.length - self.used)
            self.open.append((doc, start, ids[start : start + take], total, self.sequence, self.used))
            start, self.used = start + take, self.used + take
            if self.used == self.length:
                self._close()

    def finish(self) -> None:
        """Share what is left out over sequences whose lengths are powers of two."""
        pieces, left = self.open, self.used
        self.open, self.used = [], 0
        for doc, start, ids, total, _, _ in pieces:
            at = 0
            while at < len(ids):
                room = (1 << (left.bit_length() - 1)) - self.used
                take = min(len(ids) - at, room)
                self.open.append((doc, start + at, ids[at : at + take], total, self.sequence, self.used))
                at, self.used = at + take, self.used + take
                if take == room:
                    left -= self.used
                    self._close()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * 6
        flat = np.concatenate([np.asarray(ids, "<u4") for ids in columns[2]]) if rows else np.zeros(0, "<u4")
        length = np.fromiter(map(len, columns[2]), np.int64, len(rows))
        ends = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        longs = lambda values: pa.array(values, pa.int64())
        return pa.RecordBatch.from_arrays(
            [longs(columns[0]), longs(columns[1]), longs(length), ids, longs(columns[3]), longs(columns[4]), longs(columns[5])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def _pack(path: str, length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").fill_null("").to_pylist()
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    packer.add(doc, np.append(ids, np.uint16(END)))
                yield packer.batch()
        packer.finish()
        yield packer.batch()
        forget()

    return pack


def pack_along_curve(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers. Every id of a
    document, with the closing id, lies in one piece. A sequence holds ``length`` ids, or a
    smaller power of two at the end of a partition, so nothing needs padding. Sequence ids
    are unique and rise along the curve; they are not gapless.

    A null or empty text is a document of the closing id alone. Equal texts lie next to each
    other, parted by a hash of their ids, so that a group of copies may fill many partitions.
    Repeated rows are packed as often as they come; a null id is carried along. Other columns
    are not read.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return sort_along_curve(docs).mapInArrow(
        _pack(path, length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )

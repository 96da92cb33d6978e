"""Embedding near-dedup (2): cross-polytope hashing with verified pairs.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and
takes the nearest corner of the cross-polytope, the coordinate of largest size with its sign.
A table joins a few such hashes into a bucket. Every vector is stored in one bucket per table
and also probes the buckets it came closest to falling into. Vectors that meet are compared
by their cosine; a pair that meets in several buckets is counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressline.llm.store import stored
from pressline.operators.graph import connected_components

COSINE = 0.95
TABLES = 8
HASHES = 2
PROBES = 3
BLOCK = 1024  # a bucket with more members is compared in pairs of blocks
CHUNK = 16_384  # rows of complete buckets that are compared at once
_UNNAMED = 1 << 62


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large and tiny components do not overflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def probe_codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket codes of unit rows, ``(rows, tables, probes)``; the first probe is the stored bucket."""
    rows, dims = vectors.shape
    width = 1 << max(1, (dims - 1).bit_length())
    x = np.zeros((rows, width))
    x[:, :dims] = vectors
    near = min(3, width)  # corners per hash that probes may use
    codes = np.zeros((rows, tables, probes), np.int64)
    for table in range(tables):
        total, gap = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for k in range(hashes):
            rng = np.random.RandomState(1000 * table + k)
            y = x
            for _ in range(3):
                y = _hadamard(y * (rng.randint(0, 2, width) * 2.0 - 1)) / np.sqrt(width)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, 1)
            corner = top + width * (value < 0)
            lost = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            total = (total[:, :, None] * (2 * width) + corner[:, None, :]).reshape(rows, -1)
            gap = (gap[:, :, None] + lost[:, None, :]).reshape(rows, -1)
        best = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(total, best, 1)
        codes[:, table, : found.shape[1]] = found
        codes[:, table, found.shape[1] :] = found[:, :1]
    return codes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _signatures(tables: int, hashes: int, probes: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("dims"))
            for dims in np.unique(size):
                part = batch.filter(pa.array(size == dims))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    codes = probe_codes(unit(_matrix(some.column("embedding"))), tables, hashes, probes).reshape(some.num_rows, -1)
                    ends = (np.arange(some.num_rows + 1) * codes.shape[1]).astype(np.int32)
                    yield some.append_column("codes", pa.ListArray.from_arrays(ends, (codes % (2**31 - 1)).astype(np.int32).ravel()))

    return emit


class _Chunk:
    """Rows of complete buckets, compared all at once."""

    def __init__(self, rows: pa.Table, tables: int, probes: int):
        self.rep = rows["rep"].to_numpy()
        self.size = rows["size"].to_numpy()
        self.block = rows["block"].to_numpy()
        self.across = rows["c1"].to_numpy() != rows["c2"].to_numpy()
        slot = rows["slot"].to_numpy()
        self.table, self.stored = slot // probes, slot % probes == 0
        self.x = unit(_matrix(rows["embedding"].combine_chunks()))
        self.codes = _matrix(rows["codes"].combine_chunks()).reshape(len(slot), tables, probes)
        self.code = self.codes[np.arange(len(slot)), self.table, slot % probes]
        key = np.stack([rows["key"].to_numpy(), rows["c1"].to_numpy(), rows["c2"].to_numpy()])
        self.start = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        self.length = np.diff(np.append(self.start, len(slot)))

    def candidates(self, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket, in parts of bounded size."""
        group = np.repeat(np.arange(len(self.start)), self.length)
        small = np.repeat(self.length <= 64, self.length)
        for step in range(1, 64):
            i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step])) if step < len(group) else np.zeros(0, np.int64)
            if not len(i):
                break
            for at in range(0, len(i), 1 << 16):
                yield i[at : at + (1 << 16)], i[at : at + (1 << 16)] + step
        for begin, length in zip(self.start[self.length > 64], self.length[self.length > 64]):
            for at in range(begin, begin + length, 128):
                rows = np.arange(at, min(at + 128, begin + length))
                near = self.x[rows] @ self.x[begin : begin + length].T >= cosine - 1e-6
                a, b = np.nonzero(near)
                a, b = rows[a], begin + b
                yield a[a < b], b[a < b]

    def links(self, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that reach the cosine and belong to this bucket."""
        fits = (self.stored[i] | self.stored[j]) & (~self.across[i] | (self.block[i] != self.block[j])) & (self.rep[i] != self.rep[j])
        i, j = i[fits], j[fits]
        fits = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= cosine
        i, j = i[fits], j[fits]
        if not len(i):
            return i, j
        a, b = self.codes[i], self.codes[j]
        a_in_b = (a[:, :, :1] == b).any(axis=2)  # the bucket that stores i is probed by j
        b_in_a = (b[:, :, :1] == a).any(axis=2)
        table = self.table[i]
        own = np.argmax(a_in_b | b_in_a, axis=1) == table
        at = np.arange(len(i))
        none = np.iinfo(np.int32).max
        first = np.minimum(np.where(a_in_b[at, table], a[at, table, 0], none), np.where(b_in_a[at, table], b[at, table, 0], none))
        own &= first == self.code[i]
        return i[own], j[own]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A root per row such that linked rows have one root."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _compare(cosine: float, tables: int, probes: int):
    def compared(rows: pa.Table) -> pa.RecordBatch:
        chunk = _Chunk(rows, tables, probes)
        n = len(chunk.rep)
        links, label = np.zeros(n, np.int64), np.arange(n)
        for i, j in chunk.candidates(cosine):
            i, j = chunk.links(i, j, cosine)
            if len(i):
                links += np.bincount(i, chunk.size[j], n).astype(np.int64) + np.bincount(j, chunk.size[i], n).astype(np.int64)
                label = _forest(n, np.concatenate([np.arange(n), i]), np.concatenate([label, j]))
        found = np.flatnonzero((links > 0) | (label != np.arange(n)))
        return pa.RecordBatch.from_arrays([pa.array(chunk.rep[found]), pa.array(chunk.rep[label[found]]), pa.array(links[found])], names=["src", "dst", "links"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= CHUNK:
                key = np.stack([held[c].to_numpy() for c in ("key", "c1", "c2")])
                ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
                if len(ends):  # the last bucket may go on in the next batch
                    yield compared(held.slice(0, int(ends[-1]) + 1))
                    held = held.slice(int(ends[-1]) + 1)
        if held is not None and held.num_rows:
            yield compared(held)

    return compare


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows whose vector has a cosine of ``cosine`` or more with the
    row's, among the pairs that hashing finds; ``component_id`` is the smallest id that links
    reach. A vector that is null, empty, zero or holds null, infinite or undefined components
    links with nothing, nor do vectors of different lengths. Equal vectors are worked on once
    and all count. Rows with one id stand for one vector. A null id is allowed: the row has no
    name, but counts. Ids from 2**62 on are an error; other columns are not read.

    The hashes per table set the number of buckets, ``(2 * width) ** hashes``; raise them, and
    the tables with them, as the table grows. Buckets of any size are compared completely.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    named = F.col("vec_id").cast("long")
    named = F.when(named >= _UNNAMED, F.raise_error(F.lit("ids must be below 2**62"))).otherwise(named)
    rows = vectors.select(named.alias("vec_id"), "embedding").withColumn("good", F.coalesce(good, F.lit(False)))
    name = F.coalesce(F.min("vec_id"), F.xxhash64("embedding").bitwiseAND(F.lit(_UNNAMED - 1)) + F.lit(_UNNAMED))
    classes = rows.filter("good").groupBy("embedding").agg(name.alias("rep"), F.count(F.lit(1)).alias("size"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    signed = classes.select("rep", "size", F.size("embedding").alias("dims"), "embedding").mapInArrow(
        _signatures(tables, hashes, probes), f"rep long, size long, dims int, embedding {kind}, codes array<int>"
    )
    signed = stored(signed)

    slots = signed.select("rep", "dims", F.posexplode("codes").alias("slot", "code"))
    table = F.floor(F.col("slot") / probes)
    placed = slots.select("rep", "slot", F.xxhash64("dims", table, "code").alias("key"))
    counted = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("slot") % probes == 0).cast("int")).alias("holds")
    ).filter("n > 1 and holds = 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = placed.join(counted, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "slot", "key", "block", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2")
    )
    cells = met.join(signed.drop("dims"), "rep").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
    found = stored(cells.mapInArrow(_compare(cosine, tables, probes), "src long, dst long, links long"))

    links = found.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("src", "dst")).select(F.col("id").alias("rep"), "component")
    named = classes.join(links, "rep", "left").join(parts, "rep", "left").select(
        F.col("embedding").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = rows.join(named, F.when(F.col("good"), F.col("embedding")) == F.col("_vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(component < _UNNAMED, component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.col("component_id").isNull() | (F.col("component_id") >= _UNNAMED)).alias("kept"),
    )

"""Suffix-array dedup (4): sparse suffix arrays at minimiser positions.

A passage of fifty words holds 43 windows of eight words; the one with the smallest hash is
its minimiser, chosen by content alone, so equal passages choose equal places. Only the
suffixes that start at such places are kept. They are sorted over the whole corpus and each
is compared with its neighbours; those whose first eight words occur at two places are then
extended to the left and right, over every passage they are the minimiser of, and the
extended passages are again sorted and compared with their neighbours. What remains are the
passages of fifty words that occur at two places or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressline.llm.columns import as_before, set_aside
from pressline.llm.store import stored
from pressline.llm.textarrays import covered, slices, split_words, window_hashes, window_starts, word_hashes

PASSAGE = 50
PREFIX = 8


def _sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the first smallest value of every window of ``size`` values."""
    best, cover = np.arange(len(values)), 1
    while cover < size:
        step = min(cover, size - cover)
        a, b = best[:-step] if step else best, best[step:]
        best, cover = np.where(values[b] < values[a], b, a), cover + step
    return best


class _Places:
    """Words, passages and their minimisers of one slice of texts."""

    def __init__(self, column: pa.Array, passage: int):
        words = split_words(column)
        self.bounds, self.row = words.bounds, words.row
        self.hashes = word_hashes(words)
        self.start = window_starts(words.bounds, passage)  # of whole passages
        prefix = min(PREFIX, passage)
        self.prefixes = window_hashes(self.hashes, prefix)
        self.chosen = _sliding_argmin(self.prefixes, passage - prefix + 1)[self.start] if len(self.start) else self.start


def _suffixes(passage: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                places = _Places(part.column("text"), passage)
                at = np.unique(places.chosen)
                if len(at):
                    row = places.row[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(places.prefixes[at].view(np.int64)), part.column("doc").take(pa.array(row)), pa.array((at - places.bounds[row]).astype(np.int32))],
                        names=["key", "doc", "pos"],
                    )

    return emit


def _extensions(passage: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                places = _Places(part.column("text"), passage)
                anchors = part.column("anchors")
                sizes = np.diff(anchors.offsets.to_numpy())
                hit = np.zeros(len(places.hashes) + 1, bool)
                hit[np.repeat(places.bounds[:-1], sizes) + anchors.flatten().to_numpy()] = True
                at = places.start[hit[places.chosen]] if len(places.start) else places.start
                if len(at):
                    row = places.row[at]
                    key = window_hashes(places.hashes, passage)[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), part.column("doc").take(pa.array(row)), pa.array((at - places.bounds[row]).astype(np.int32))],
                        names=["key", "doc", "pos"],
                    )

    return emit


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows of a sorted partition that share their key with a neighbour.

    Emits ``key, doc, pos, first, edge, n``: places whose key has two places in this
    partition, with ``first`` for the first of them. The first places of the partition's
    first and last key may have partners in other partitions; they are emitted as ``edge``
    with ``n``, the number of places seen here (2 for more).
    """

    def rows(key, doc, pos, first, edge, n):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, kind) for v, kind in zip((key, doc, pos, first, edge, n), kinds)],
            names=["key", "doc", "pos", "first", "edge", "n"],
        )

    held = None  # first place of the last key so far, whether that key opened the partition, places seen
    last = None  # the last place, to skip repeated rows
    for batch in batches:
        key, doc, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        fresh[0] = (key[0], doc[0], pos[0]) != last
        key, doc, pos = key[fresh], doc[fresh], pos[fresh]
        if not len(key):
            continue
        last = (key[-1], doc[-1], pos[-1])
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        first = np.zeros(len(key), bool)
        first[start] = True
        out = np.repeat(size > 1, size)
        edge = np.zeros(len(key), bool)
        n = np.where(out, 2, 1)
        goes_on = held is not None and held[0] == key[0]
        if goes_on:
            first[0], out[: size[0]] = False, True
            held = (*held[:4], 2)
        elif held is None and len(start) > 1:
            edge[0] = out[0] = True
        if not (goes_on and len(start) == 1):
            if held is not None and (held[3] or held[4] > 1):
                yield rows([held[0]], [held[1]], [held[2]], [True], [held[3]], [held[4]])
            opening, at = held is None and len(start) == 1, start[-1]
            held = (key[at], doc[at], pos[at], opening, int(n[at]))
            out[at] = False
        if out.any():
            yield rows(key[out], doc[out], pos[out], first[out], edge[out], n[out])
    if held is not None:
        yield rows([held[0]], [held[1]], [held[2]], [True], [True], [held[4]])


def repeated_places(places: DataFrame) -> DataFrame:
    """The rows ``key, doc, pos`` whose key occurs at two places or more, and ``first``.

    All rows are sorted by key and place over the whole cluster; a key with very many places
    spreads over as many partitions as it fills. ``first`` marks the first place of a key.
    """
    order = ["key", "doc", "pos"]
    ranked = places.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = stored(ranked.mapInArrow(_compare, "key long, doc long, pos int, first boolean, edge boolean, n int"))
    # Two rows per partition at most: what each partition knows of its first and last key.
    edges = seen.filter("edge")
    known = edges.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.struct("doc", "pos")).alias("least"))
    settled = edges.join(known, "key").filter("total > 1").select(
        "key", "doc", "pos", (F.struct("doc", "pos") == F.col("least")).alias("first")
    )
    return seen.filter("not edge").select("key", "doc", "pos", "first").unionByName(settled)


def _spans(passage: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, end, removed = [], [], [], []
            for row in range(batch.num_rows):
                at = np.sort(batch.column("at")[row].values.to_numpy())
                pos, first = at // 2, at % 2 == 1
                total = int(pos[-1]) + passage
                every, keep = covered(pos, passage, total), covered(pos[first], passage, total)
                kind = np.where(every, np.where(keep, 1, 2), 0)
                cut = np.flatnonzero(np.diff(kind)) + 1
                begin = np.concatenate([[0], cut])
                used = kind[begin] > 0
                doc += [batch.column("doc")[row].as_py()] * int(used.sum())
                start += begin[used].tolist()
                end += np.append(cut, total)[used].tolist()
                removed += (kind[begin][used] == 2).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(removed, pa.bool_())],
                names=["doc", "span_start", "span_end", "removed"],
            )

    return merge


def _named(docs: DataFrame) -> DataFrame:
    """Rows with a text, with a hash of id and text as their place in the corpus."""
    return docs.filter(F.col("text").isNotNull()).withColumn("doc", F.xxhash64("doc_id", "text"))


def repeated_spans(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``doc, span_start, span_end, removed``: word ranges covered by repeated passages.

    A passage is ``passage`` consecutive words; it is repeated when the same words occur at
    another place, in the same text or another. Of the places of a passage one stays as the
    first, the smallest by a hash of the document. Words that only later places cover are
    ``removed``; words covered by a first place are not. Ranges count words from 0 and do not
    overlap. Texts that are null or shorter than a passage have no range. Rows with equal id
    and text are one document and do not repeat each other.
    """
    named = _named(docs)
    suffixes = named.select("doc", "text").mapInArrow(_suffixes(passage), "key long, doc long, pos int")
    anchors = repeated_places(suffixes).groupBy("doc").agg(F.collect_set("pos").alias("anchors"))
    extended = (
        named.select("doc", "text").join(anchors.hint("shuffle_hash"), "doc")
        .mapInArrow(_extensions(passage), "key long, doc long, pos int")
    )
    at = F.col("pos") * 2 + F.col("first").cast("int")
    listed = repeated_places(extended).groupBy("doc").agg(F.collect_set(at).alias("at"))
    return listed.mapInArrow(_spans(passage), "doc long, span_start int, span_end int, removed boolean")


def suffix_duplicates(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """The ranges of :func:`repeated_spans` with the ``doc_id`` of their row."""
    ids = _named(docs).select("doc", "doc_id").distinct()
    return repeated_spans(docs, passage).join(ids, "doc").select("doc_id", "span_start", "span_end", "removed")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = split_words(part.column("text"))
            raw = words.data.tobytes()
            spans = part.column("spans")
            ends = spans.offsets.to_numpy()
            flat = spans.flatten()
            start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            texts = []
            for row, old in enumerate(part.column("text")):
                mine = slice(ends[row] - ends[0], ends[row + 1] - ends[0])
                if mine.start == mine.stop:
                    texts.append(old.as_py())
                    continue
                at, begin, left = int(words.bounds[row]), int(words.offsets[row]), []
                for a, b in sorted(zip(start[mine].tolist(), end[mine].tolist())):
                    left.append(raw[begin : words.start[at + a]])
                    begin = int(words.end[at + b - 1])
                left.append(raw[begin : words.offsets[row + 1]])
                texts.append(b"".join(left).decode().strip())
            yield part.drop_columns(["text", "spans"]).append_column("text", pa.array(texts, pa.string()))


def remove_duplicates(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``docs`` without the removed ranges; texts of which no word is left go.

    Only ``text`` and, where present, ``n_chars`` change. Null texts stay as they are, empty
    ones go. Repeated rows lose the same words, since rows with equal id and text are one
    document. An empty table stays empty.
    """
    own = ("doc_id", "text", "n_chars")
    plain = set_aside(docs, *own)
    spans = repeated_spans(plain, passage).filter("removed").groupBy("doc").agg(
        F.collect_list(F.struct("span_start", "span_end")).alias("spans")
    ).select(F.col("doc").alias("_doc"), "spans")
    empty = F.array().cast("array<struct<span_start:int,span_end:int>>")
    marked = plain.withColumn("_doc", F.xxhash64("doc_id", "text")).join(spans.hint("shuffle_hash"), "_doc", "left").withColumn(
        "spans", F.coalesce("spans", empty)
    )
    others = [c for c in plain.columns if c != "text"]
    narrow = marked.select(*others, "text", "spans")
    schema = narrow.select(*others, "text").schema
    left = narrow.mapInArrow(_cut, schema).filter("text is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return as_before(left, docs, *own)

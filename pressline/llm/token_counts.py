"""Token counts (7): rank-synchronous merging of byte-pair tokens in arrays.

Texts are split by the vocabulary's own pattern. Distinct pre-tokens are held as one flat
array of symbols with row bounds. In every round each row finds its adjacent pair of lowest
merge rank and all rows merge theirs at once; a row without a mergeable pair is done and its
surviving symbols are counted. Counts of frequent pre-tokens are remembered per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from pressline.llm.textarrays import slices, utf8

LIMIT = 1024
_NONE = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(rest)}


class RankMerger:
    """Counts byte-level BPE tokens of pre-tokens, all rows of a batch at once."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        symbols = _byte_letters()
        keys, into = [], []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            merged = symbols.setdefault(left + right, len(symbols))
            keys.append((symbols[left] << 32) | symbols[right])
            into.append((rank, merged))
        order = np.argsort(keys)
        self.keys = np.asarray(keys, np.int64)[order]
        self.rank = np.asarray([r for r, _ in into], np.int32)[order]
        self.into = np.asarray([m for _, m in into], np.int64)[order]
        self.counts: dict[str, int] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def merge(self, rows: list[bytes]) -> np.ndarray:
        """The number of tokens of every row."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        out = np.minimum(size, 1)
        todo = np.flatnonzero(size > 1)
        if not len(todo):
            return out
        symbol = np.frombuffer(b"".join(rows[k] for k in todo), np.uint8).astype(np.int64)
        row = np.repeat(todo, size[todo])
        pair = np.full(len(symbol), -1, np.int64)  # the merge of a symbol with the next one of its row
        inner = np.flatnonzero(row[1:] == row[:-1])
        pair[inner] = self._find(symbol[inner], symbol[inner + 1])
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            length = np.diff(np.append(start, len(row)))
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            least = np.minimum.reduceat(rank, start)
            done = least == _NONE
            out[row[start[done]]] = length[done]
            if done.any():
                keep = np.repeat(~done, length)
                symbol, row, pair, rank = symbol[keep], row[keep], pair[keep], rank[keep]
                length, least = length[~done], least[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            # In a run of equal neighbours such as "aaa" every second place merges, from the left.
            begin = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, hit, 0))
            hit = hit[(hit - begin) % 2 == 0]
            symbol[hit] = self.into[pair[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[hit] = True
            symbol, row, pair, changed = symbol[stay], row[stay], pair[stay], changed[stay]
            at = np.flatnonzero(changed)
            at = np.union1d(at, at[at > 0] - 1)
            has_next = at + 1 < len(row)
            has_next[has_next] &= row[at[has_next] + 1] == row[at[has_next]]
            pair[at[~has_next]] = -1
            at = at[has_next]
            pair[at] = self._find(symbol[at], symbol[at + 1])
        return out

    def count(self, texts: list[str], entries: int = 400_000) -> list[int]:
        """The number of tokens of every text; special tokens inside a text count as one."""
        split, extra = [], []
        for text in texts:
            n, parts = 0, [text]
            for token in self.special:
                if token in text:
                    parts = [piece for part in parts for piece in part.split(token)]
                    n += text.count(token)
            split.append([piece for part in parts for piece in self.pattern.findall(part)])
            extra.append(n)
        new = list({piece for pieces in split for piece in pieces}.difference(self.counts))
        if new:
            self.counts.update(zip(new, self.merge([piece.encode() for piece in new]).tolist()))
        known = self.counts.__getitem__
        counted = [n + sum(map(known, pieces)) for n, pieces in zip(extra, split)]
        for piece in new[max(0, len(new) - max(0, len(self.counts) - entries)) :]:
            del self.counts[piece]  # the memo stays within its bound
        return counted


_loaded: dict[str, RankMerger] = {}


def _merger(path: str) -> RankMerger:
    if path not in _loaded:
        _loaded[path] = RankMerger(path)
    return _loaded[path]


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for batch in batches:
            for part in slices(batch):
                _, offsets = utf8(part.column("text"))
                tokens = merger.count(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(offsets[1:] - offsets[:-1]), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return count


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary`` is a byte-level BPE file without normalisation. Counts are those of its
    library for whole texts, without begin or end tokens. A null or empty text has no tokens.
    Rows are counted one by one, so repeated rows and null ids are kept; other columns are not
    read and no shuffle takes place.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

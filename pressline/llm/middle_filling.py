"""Fill-in-middle transformation (11): units found and cut in 64-bit words of UTF-8.

The bytes of many texts are viewed as ``uint64`` words and worked on eight at a time. Plain
arithmetic marks, in the high bit of each byte, the bytes that end a unit and those that start
a character. ``bitwise_count`` and a running sum give the number of marks before every word, so
that the place of the k-th unit is a binary search for its word and a select inside that word,
and a count of characters is a difference of two ranks. No text is ever decoded or split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressline.llm.textarrays import slices, utf8

SENTINELS = ("<P>", "<S>", "<M>")  # fixed values: before the prefix, the suffix and the middle
SEED = "42"
TRANSFORMED = 50  # per cent of the texts
SUFFIX_FIRST = 80  # per cent of the transformed texts

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_SHIFT8, _SHIFT56 = np.uint64(8), np.uint64(56)


def _every(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian words, zeros after the last byte."""
    padded = np.zeros((len(data) + 8) // 8 * 8, np.uint8)  # one byte of padding at least
    padded[: len(data)] = data
    return padded.view("<u8")


def _spaces(words: np.ndarray) -> np.ndarray:
    """High bits of the bytes 0x20 and 0x09 to 0x0D; no sum ever carries into the next byte."""
    low = words & _LOW7
    other = words ^ _every(0x20)
    blank = ~(((other & _LOW7) + _LOW7) | other)
    control = (low + _every(0x80 - 0x09)) & ~(low + _every(0x80 - 0x0E)) & ~words
    return (blank | control) & _HIGH


def _at(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return places >> 3, ((places & 7) << 3).astype(np.uint64)


def unit_ends(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """High bits of the bytes that end a unit; ``last`` are the last bytes of non-empty texts.

    A unit is white space followed by a word, or the white space that ends a text: it ends where
    a byte of a word precedes white space, and at the end of its text.
    """
    space = _spaces(words)
    follows = space >> _SHIFT8
    follows[:-1] |= space[1:] << _SHIFT56
    ends = follows & ~space & _HIGH
    word, shift = _at(last)
    np.bitwise_or.at(ends, word, np.uint64(0x80) << shift)
    return ends


def characters(words: np.ndarray) -> np.ndarray:
    """High bits of the bytes that start a character: all but ``10xxxxxx``."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks before each byte."""
        word, shift = _at(places)
        inside = self.marks[word] & ((np.uint64(1) << shift) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte of the ``number``-th mark, counted from 1."""
        word = np.searchsorted(self.before, number, "left") - 1
        wanted = (number - self.before[word]).astype(np.uint64)
        running = (self.marks[word] >> np.uint64(7)) * _ONES  # byte i holds the marks up to byte i
        reached = ((running | _HIGH) - wanted * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def _cuts(part: pa.RecordBatch) -> tuple[bytes, dict[str, np.ndarray]]:
    """All bytes of a slice, and the numbers of every row: units, ends of prefix and middle, characters."""
    data, offsets = utf8(part.column("text"))
    words = as_words(data)
    begin, end = offsets[:-1], offsets[1:]
    units, starts = Marks(unit_ends(words, end[end > begin] - 1)), Marks(characters(words))
    first = units.rank(begin)
    n = units.rank(end) - first
    h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in range(1, 5))
    one, two = h1 % (n + 1), h2 % (n + 1)

    def byte_after(count: np.ndarray) -> np.ndarray:
        place = begin.copy()
        some = count > 0
        place[some] = units.select(first[some] + count[some]) + 1
        return place

    a, b = byte_after(np.minimum(one, two)), byte_after(np.maximum(one, two))
    start = starts.rank(begin)
    return data.tobytes(), {
        "n": n, "begin": begin, "a": a, "b": b, "end": end, "h3": h3, "h4": h4,
        "prefix_chars": starts.rank(a) - start, "middle_chars": starts.rank(b) - starts.rank(a),
    }


def _transform(transformed: int, suffix_first: int):
    before, after, between = (s.encode() for s in SENTINELS)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, cut = _cuts(part)
                plain = (cut["begin"] == cut["end"]) | part.column("marked").to_numpy(zero_copy_only=False) | (cut["h3"] % 100 >= transformed)
                spm = ~plain & (cut["h4"] % 100 < suffix_first)
                texts = []
                for k, (begin, a, b, end) in enumerate(zip(*(cut[c].tolist() for c in ("begin", "a", "b", "end")))):
                    if plain[k]:
                        texts.append(raw[begin:end])
                    elif spm[k]:
                        texts.append(b"".join((after, raw[b:end], before, raw[begin:a], between, raw[a:b])))
                    else:
                        texts.append(b"".join((before, raw[begin:a], after, raw[b:end], between, raw[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(cut["n"].astype(np.int64)), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object), pa.string()),
                        pa.array(cut["prefix_chars"].astype(np.int64), mask=plain), pa.array(cut["middle_chars"].astype(np.int64), mask=plain),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return transform


def fill_in_middle(docs: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    A text is ``n`` units, white space with the word after it or white space at its end. Two of
    the ``n + 1`` borders, drawn by a hash of ``seed`` and the id, cut it into prefix, middle and
    suffix. ``form`` is ``spm`` (suffix, prefix, middle), ``psm`` (prefix, suffix, middle), each
    part behind its sentinel, or ``plain``: the text as it is. ``transformed`` and
    ``suffix_first`` are per cent. Texts that hold a sentinel are plain, and so are empty and
    null ones, whose output is the empty text. A null id is hashed as the empty string. Repeated
    rows are treated one by one and alike; other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for sentinel in SENTINELS:
        marked = marked | text.contains(sentinel)
    hashed = docs.select("doc_id", text.alias("text"), marked.alias("marked"), digest.alias("digest"))
    numbers = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return hashed.select("doc_id", "text", "marked", *numbers).mapInArrow(
        _transform(transformed, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` turned into ``output``; no sentinel can stand inside its parts."""
    part = lambda k: F.get(F.split(output, "<[PSM]>", -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)

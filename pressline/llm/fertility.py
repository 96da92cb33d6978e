"""Quality rules (8): word statistics and tokeniser fertility.

A public vocabulary is a yardstick for ordinary text. Ordinary prose takes few tokens per
character, hardly ever falls back to single bytes and spreads over many different tokens.
Symbol soup and shouting need many tokens per character; chanted words use few different
tokens. Per text the operator measures characters per token, the share of byte-fallback
tokens and the entropy of the tokens, and rejects a text outside the band of its language.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from pressline.llm.columns import as_before, set_aside
from pressline.llm.memo import TokenMemo, give_back, joined
from pressline.llm.textarrays import SPACE, occurrence, slices, span_hashes, split_lines, split_words, window_hashes, window_starts, word_hashes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50


# The least token entropy in bits of a text with 2**6, 2**7, … 2**13 tokens, before the
# language's own allowance: a longer text has room for more different tokens.
ENTROPY_FLOOR = (5.20, 5.45, 5.75, 6.05, 6.30, 6.42, 6.48, 6.52)


@dataclass(frozen=True)
class Band:
    """Limits inside which a text is kept; the allowance moves the entropy floor."""

    min_chars_per_token: float
    max_chars_per_token: float = 12.0
    max_fallback_share: float = 0.10
    entropy_allowance: float = -0.06


# Bands by the language of a row, else by the script most letters are of.
BANDS: Mapping[str, Band] = {
    "en": Band(1.70, entropy_allowance=0.10), "de": Band(1.70, entropy_allowance=0.08), "fr": Band(1.50), "es": Band(1.60),
    "latin": Band(1.50), "cyrillic": Band(1.20), "other": Band(0.25, max_fallback_share=0.95, entropy_allowance=-1.0),
}

STATISTICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, fallback_share double, token_entropy double, entropy_margin double, script string"
)


def _earlier_equal(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, how many values equal an earlier one of the row."""
    return np.bincount(row[occurrence(values, row) > 0], minlength=rows)


def _repeated(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their row."""
    if not len(values):
        return np.zeros(0, bool)
    own = np.stack([row.astype(np.uint64), values])
    order = np.lexsort(own[::-1])
    ranked = own[:, order]
    same = (ranked[:, 1:] == ranked[:, :-1]).all(axis=0)
    twice = np.zeros(len(values), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def _script(words) -> np.ndarray:
    """The script of most letters, from the lead bytes of the characters."""
    row = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    lead, n = words.data, len(words.offsets) - 1
    letter = ((lead | 0x20) >= 0x61) & ((lead | 0x20) <= 0x7A)
    latin = np.bincount(row[letter | ((lead >= 0xC3) & (lead <= 0xCA))], minlength=n)
    cyrillic = np.bincount(row[(lead >= 0xD0) & (lead <= 0xD3)], minlength=n)
    other = np.bincount(row[(lead >= 0xCB) & ~((lead >= 0xD0) & (lead <= 0xD3)) & (lead != 0xE2)], minlength=n)
    most = np.argmax(np.stack([latin, cyrillic, other]), axis=0)
    return np.array(["latin", "cyrillic", "other"], object)[most]


_loaded: dict[str, tuple] = {}


def _release() -> None:
    """Give up what a task remembered."""
    _loaded.clear()
    give_back()


def _vocabulary(path: str) -> tuple[TokenMemo, np.ndarray]:
    """The worker's memo for a vocabulary file and which of its ids are byte fallback."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        fallback = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.vocab_size())])
        memo = TokenMemo(lambda words: joined(model.encode([w.decode() for w in words], num_threads=1)))
        _loaded[path] = memo, fallback
    return _loaded[path]


def _token_statistics(words, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy in bits per row."""
    memo, fallback = _vocabulary(path)
    rows = len(words.offsets) - 1
    raw = words.data.tobytes()
    split = [raw[a:b].split() for a, b in zip(words.offsets[:-1], words.offsets[1:])]
    length, ids = memo.tokens([w for part in split for w in part])
    row = np.repeat(words.row, length)
    tokens = np.bincount(row, minlength=rows)
    bytes_ = np.bincount(row[fallback[ids]], minlength=rows)
    kinds, times = np.unique(row * len(fallback) + ids, return_counts=True)
    of = kinds // len(fallback)
    share = times / np.maximum(tokens[of], 1)
    entropy = np.bincount(of, -share * np.log2(share), minlength=rows)
    return tokens, bytes_, entropy


def statistics(column: pa.Array, path: str) -> dict[str, np.ndarray]:
    words = split_words(column)
    rows, row = len(words.offsets) - 1, words.row
    byte_row = np.repeat(np.arange(rows), np.diff(words.offsets))
    character = ~SPACE[words.data] & ((words.data & 0xC0) != 0x80)
    symbol = np.isin(words.data, np.frombuffer(SYMBOLS, np.uint8))
    hashes = word_hashes(words)
    at = window_starts(words.bounds, 3)
    again = at[_repeated(window_hashes(hashes, 3)[at], row[at])]
    hit = np.zeros(len(hashes) + 2, bool)
    for step in range(3):
        hit[again + step] = True
    first, last = split_lines(words)
    with_word = np.searchsorted(words.start, last) > np.searchsorted(words.start, first)
    first, last = first[with_word], last[with_word]
    line_row = np.searchsorted(words.offsets, first, "right") - 1
    word_chars = np.bincount(byte_row[character], minlength=rows)
    tokens, fallback, entropy = _token_statistics(words, path)
    return {
        "n_words": words.counts,
        "word_chars": word_chars,
        "n_symbols": np.bincount(byte_row[symbol], minlength=rows),
        "n_dup_lines": _earlier_equal(span_hashes(words.data, first, last), line_row, rows),
        "n_repeat_words": np.bincount(row[hit[: len(hashes)]], minlength=rows),
        "n_tokens": tokens,
        "chars_per_token": word_chars / np.maximum(tokens, 1),
        "fallback_share": fallback / np.maximum(tokens, 1),
        "token_entropy": entropy,
        "entropy_margin": entropy - np.interp(np.log2(np.maximum(tokens, 1)), range(6, 14), ENTROPY_FLOOR),
        "script": _script(words),
    }


def text_statistics(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, lang)`` of every row with its statistics, from whole texts in one pass."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    schema = f"{docs.select('doc_id').schema['doc_id'].simpleString().replace(':', ' ', 1)}, lang string, {STATISTICS}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = statistics(part.column("text"), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *map(pa.array, found.values())], names=["doc_id", "lang", *found]
                )
        _release()

    return docs.select("doc_id", "lang", "text").mapInArrow(measure, schema)


def verdicts(statistics: DataFrame, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """Add ``base_failed``, the reasons of the band and ``kept``."""
    table = F.create_map(
        *[x for name, band in bands.items() for x in (
            F.lit(name),
            F.struct(
                F.lit(band.min_chars_per_token).alias("low"), F.lit(band.max_chars_per_token).alias("high"),
                F.lit(band.max_fallback_share).alias("fallback"), F.lit(band.entropy_allowance).alias("allowance"),
            ),
        )]
    )
    band = F.coalesce(F.try_element_at(table, F.col("lang")), F.try_element_at(table, F.col("script")), F.try_element_at(table, F.lit("other")))
    judged = statistics.withColumn("_band", band).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("chars_per_token") < F.col("_band.low"), F.lit("many tokens per character")),
            F.when(F.col("chars_per_token") > F.col("_band.high"), F.lit("few tokens per character")),
            F.when(F.col("fallback_share") > F.col("_band.fallback"), F.lit("byte fallback")),
            F.when(F.col("entropy_margin") < F.col("_band.allowance"), F.lit("low token entropy")),
        ),
        lambda reason: reason.isNotNull(),
    )
    return judged.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("_band")


def quality_rules(docs: DataFrame, vocabulary: str | None = None, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """One row per row of ``docs``: statistics, ``base_failed``, ``reasons`` and ``kept``.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed
    and carriage return. A null text counts as empty: no words, so it fails the base rules.
    A null or unknown language takes the band of the text's script. Repeated rows are judged
    one by one; other columns of ``docs`` are not read. Every word is encoded on its own,
    which for this kind of vocabulary gives the tokens of the whole text, since its pieces
    never reach over white space.
    """
    return verdicts(text_statistics(docs, vocabulary), bands)


def passing(docs: DataFrame, vocabulary: str | None = None, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, in one pass.

    Null and empty texts go, since they fail the base rules; repeated rows are judged one by one
    and stay as often as they come. An empty table stays empty.
    """
    own = ("lang", "text")
    plain = set_aside(docs, *own)
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    names = [name for name in _statistic_names() if name not in ("n_tokens", "word_chars", "n_symbols", "n_dup_lines")]
    added = {name: f"_rule_{name}" for name in names}
    schema = StructType(plain.schema.fields[:])
    for name, kind in _statistic_kinds():
        if name in added:
            schema = schema.add(added[name], kind)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = statistics(part.column("text"), path)
                for name in names:
                    part = part.append_column(added[name], pa.array(found[name]))
                yield part
        _release()

    measured = plain.mapInArrow(measure, schema)
    judged = verdicts(measured.select(F.col("lang"), *[F.col(added[n]).alias(n) for n in names], F.struct(*plain.columns).alias("_row")), bands)
    return as_before(judged.filter("kept").select("_row.*"), docs, *own)


def _statistic_kinds() -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in STATISTICS.split(", ")]


def _statistic_names() -> list[str]:
    return [name for name, _ in _statistic_kinds()]

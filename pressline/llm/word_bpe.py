"""Token ids of whole texts for a BPE vocabulary that drops white space."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from pressline.llm.memo import TokenMemo, give_back, joined

# How the vocabulary's own file splits a text without white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Lines of Latin letters, blanks and single marks: their pieces are the words and the marks.
PLAIN_LINE = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-į\u0131-ɏ ]++|[.,;:!?](?![.,;:!?]))*+")
MARKS = ".,;:!?"

WHOLE = "\0"  # marks a part that is encoded by itself
PARTS = 300_000


class WordBpe:
    """Ids as the ``tokenizers`` library gives them, mostly from memory.

    White space never reaches a token of such a vocabulary, so a text's ids are those of its
    lines and of their words. Lines of plain Latin letters and single marks are taken apart by
    string methods. Words of other lines are remembered; new ones of Latin characters are split
    by the file's own pattern, the rest is encoded by the library, as are whole texts that hold
    special tokens or control characters that only Python takes for white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PIECES)
        self.parts = TokenMemo(self._encode_parts, PARTS)
        self.words = TokenMemo(self._encode_words)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts; plain ones, one piece of the pattern each, are encoded in one call."""
        plain = [part for part in parts if part[0] != WHOLE]
        encoding = self.library.encode(" ".join(plain), add_special_tokens=False)
        place = np.asarray(encoding.word_ids, np.int64)
        if len(plain) == len(parts) and len(place) and place[-1] + 1 == len(parts):
            return np.bincount(place, minlength=len(parts)), np.asarray(encoding.ids, np.uint16)
        return joined([self.library.encode(part.lstrip(WHOLE), add_special_tokens=False).ids for part in parts])

    def _split(self, word: str) -> list[str]:
        """The parts of a word; a word of other than Latin characters is one part, marked as such."""
        if max(word) >= "ɐ":
            return [WHOLE + word]
        if word.isalpha():
            return [word.lower()]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1]]
        return self.pattern.findall(word.lower())

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self._split, words))
        length, ids = self.parts.tokens(list(chain.from_iterable(split)))
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *map(len, split)])]
        return np.diff(ends), ids

    def _splits(self, text: str) -> bool:
        return not any(token in text for token in self.special) and not any(c in text for c in "\0\x1c\x1d\x1e\x1f")

    def _pieces(self, line: str) -> list[str] | None:
        """The parts of a plain line."""
        if PLAIN_LINE.fullmatch(line) is None:
            return None
        line = line.lower()
        for mark in MARKS:
            if mark in line:
                line = line.replace(mark, f" {mark} ")
        return line.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        simple = [self._splits(text) for text in texts]
        split = [text.split("\n") if ok else [] for text, ok in zip(texts, simple)]
        lines = list(chain.from_iterable(split))
        pieces = list(map(self._pieces, lines))
        found: list = [None] * len(lines)
        for plain, memo in ((True, self.parts), (False, self.words)):
            mine = [k for k, own in enumerate(pieces) if (own is not None) == plain]
            parts = [pieces[k] if plain else lines[k].split() for k in mine]
            length, ids = memo.tokens(list(chain.from_iterable(parts)))
            ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *map(len, parts)])].tolist()
            for k, a, b in zip(mine, ends[:-1], ends[1:]):
                found[k] = ids[a:b]
        out, at = [], 0
        for text, ok, own in zip(texts, simple, split):
            out.append(np.concatenate(found[at : at + len(own)]) if ok else self._whole(text))
            at += len(own)
        return out


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def forget() -> None:
    """Give up what the worker's encoders remember of a task's texts."""
    for encoder in _loaded.values():
        encoder.parts.forget()
        encoder.words.forget()
    give_back()

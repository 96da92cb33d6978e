"""Phrases of many outlets found in one pass.

All phrases form one automaton that reads a text once, whatever their number, and says for
every phrase it meets which outlets own it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST_CHARACTERS = 8_000_000  # of all phrases; the automaton stands in every Python worker
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(text: str) -> str:
    """A-Z in lower case and nothing else, as the case-blind patterns of :mod:`extract` compare."""
    return text.encode().translate(_LOWER).decode()


def _finder(owners: dict[str, frozenset]):
    """A function from (owner, text) to whether the text holds a phrase of the owner."""
    import ahocorasick

    always = owners.get("", frozenset())  # an empty phrase is in every text
    automaton = ahocorasick.Automaton()
    for phrase, own in owners.items():
        if phrase:
            automaton.add_word(phrase, own)
    if len(automaton):
        automaton.make_automaton()

    def holds(owner, text: str) -> bool:
        if owner in always:
            return True
        return bool(len(automaton)) and any(owner in own for _, own in automaton.iter(fold(text)))

    return holds


def _mark(owners: dict[str, frozenset]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = _finder(owners)
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            found = [None if text is None else holds(owner, text) for owner, text in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["id", "held"])

    return mark


def owned_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``id, held``: whether a text holds a phrase of its own outlet, in any case of A-Z.

    ``texts`` has ``id, owner, text``, ``phrases`` has ``owner, phrase``. A null text gives
    null; an owner without phrases holds none; an empty phrase is in every text; null owners and
    phrases are left out. The phrases are a table of rules: all of them together may have
    ``MOST_CHARACTERS`` characters, more is an error.
    """
    rules = phrases.filter("owner is not null and phrase is not null").select("owner", "phrase").distinct()
    size = rules.agg(F.coalesce(F.sum(F.length("phrase") + 1), F.lit(0))).first()[0]
    if size > MOST_CHARACTERS:
        raise ValueError(f"{size} characters of phrases are more than {MOST_CHARACTERS}")
    owners: dict[str, set] = {}
    for owner, phrase in rules.collect():
        owners.setdefault(fold(phrase), set()).add(owner)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "owner", "text").mapInArrow(_mark({p: frozenset(o) for p, o in owners.items()}), f"id {kind}, held boolean")

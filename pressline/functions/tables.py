"""Table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

_BREAK = re.compile(r"(?<=[.!?])\s+", re.ASCII)


@F.udtf(returnType="pos int, chunk string", useArrow=True)
class PackSentences:
    """T13 as a table function: ``pack_sentences(text, max_length)`` gives ``pos, chunk``.

    The rows are those of :func:`pressline.functions.text.pack_sentences`: sentences are packed
    greedily, one longer than the limit stays whole. A null text has no rows.
    """

    def eval(self, text: str, max_length: int) -> Iterator[tuple[int, str]]:
        pos, chunk = 0, ""
        for part in _BREAK.split((text or "").replace("\n", " ")):
            sentence = part.strip()
            if not sentence:
                continue
            if chunk and len(chunk) + 1 + len(sentence) > max_length:
                yield pos, chunk
                pos, chunk = pos + 1, sentence
            else:
                chunk = f"{chunk} {sentence}" if chunk else sentence
        if chunk:
            yield pos, chunk


def register(spark: SparkSession) -> None:
    """Make the table functions usable in SQL: ``FROM t, LATERAL pack_sentences(t.text, 280)``."""
    spark.udtf.register("pack_sentences", PackSentences)

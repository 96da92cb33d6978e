"""License scans (13): a positional index of rare words of license notices.

Templates are the wordings that licenses ask to be put into files. Document frequencies of
their words are counted over the whole corpus; of each template the rarest words (the highest
inverse document frequencies) are indexed with their positions. A file looks up those of its
words that are indexed, every hit votes for a template and a relative position, and votes that
agree on where the template would lie are put together. A template is accepted when enough of
its indexed weight stands where it should and all of its mandatory phrases stand there word
for word. Everything is DataFrame work: no row of text leaves the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressline.functions.binding import let
from pressline.llm.store import stored


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for and phrases that must occur word for word."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Phrases that name a license by themselves, with their labels.
BASE_PHRASES: Mapping[str, str] = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}

# Notices in the wording their licenses give.
TEMPLATES: Sequence[Template] = (
    Template("agpl", "GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        ("except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    Template(
        "bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met", ("redistribution and use in source and binary forms",),
    ),
    Template(
        "bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission", ("endorse or promote products derived from this software",),
    ),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template(
        "cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        ("copyright and related or neighboring rights",),
    ),
    Template(
        "epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        ("eclipse public license",),
    ),
    Template(
        "gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license"),
    ),
    Template(
        "gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license"),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",),
    ),
    Template("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template(
        "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at", ("mozilla public license",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template(
        "zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software", ("without any express or implied warranty", "authors be held liable for any damages"),
    ),
)
INDEXED = 12  # words of a template that are indexed at most; of a short one the rarer half
BAND = 8  # how far hits may drift from the template's own distances, in words
LEAST_SHARE = 0.6  # of a template's indexed weight

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORD = ""  # counted once for every row


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null.

    ``lower`` changes other letters too, but only the Kelvin sign would turn into a plain
    letter, so it is made another letter first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(plain, _SEPARATORS, -1), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def word_weights(docs: DataFrame, templates: Sequence[Template]) -> dict[str, tuple[int, int]]:
    """``(document frequency, weight)`` of every template word; one bounded row per word is collected.

    The weight is a thousand times the inverse document frequency, at least one.
    """
    vocabulary = sorted({w for t in templates for w in template_words(t.text)})
    present = F.array_append(F.array_intersect(words_of(F.col("text")), _strings(vocabulary)), F.lit(_NO_WORD))
    counts = dict(docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count(F.lit(1))).collect())
    rows = counts.get(_NO_WORD, 0)
    found = {w: counts.get(w, 0) for w in vocabulary}
    return {w: (n, max(1, math.floor(1000 * math.log((rows + 1) / (n + 1)) + 0.5))) for w, n in found.items()}


def rarest_words(template: Template, weights: Mapping[str, tuple[int, int]]) -> list[str]:
    """The words of a template that are indexed: the rarest first, the rarer half of a short one."""
    distinct = sorted(set(template_words(template.text)), key=lambda w: (weights[w][0], w))
    return distinct[: min(INDEXED, (len(distinct) + 1) // 2)]


def _postings(templates: Sequence[Template], weights: Mapping[str, tuple[int, int]]) -> list[tuple]:
    """``(item, template, place, weight, phrase)`` for every indexed word and mandatory phrase."""
    rows = []
    for number, template in enumerate(templates):
        words = template_words(template.text)
        for word in rarest_words(template, weights):
            rows += [(word, number, place, weights[word][1], False) for place, w in enumerate(words) if w == word]
        for phrase in template.phrases:
            parts = phrase.split()
            place = next(k for k in range(len(words)) if words[k : k + len(parts)] == parts)
            rows.append((phrase, number, place, 0, True))
    return rows


def _table(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small table of literals."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _phrase_places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively."""
    parts = phrase.split()

    def here(at: Column) -> Column:
        same = F.get(words, at) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, at + k) == part)
        return same

    none = F.array().cast("array<int>")
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.when(text.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(none)


def _measured(text: Column, base: Mapping[str, str], index: Sequence[str], phrases: Sequence[str], weights: Mapping[str, tuple[int, int]]) -> Column:
    """``n_words``, the places of the base phrases and all hits (``item``, ``pos``) of a text, in one struct."""
    key = {phrase: min(phrase.split(), key=lambda w: (weights.get(w, (0, 0))[0], w)) for phrase in [*base, *phrases]}  # its rarest word
    looked_up = _strings(sorted({*index, *key.values()}))
    none = F.array().cast("array<int>")

    def measure(row: Column) -> Column:
        words, present = row["words"], row["present"]
        places = {p: F.when(F.array_contains(present, key[p]), _phrase_places(words, p)).otherwise(none) for p in key}
        some = F.size(present) > 0
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("item"), i.alias("pos")))
        indexed = F.filter(numbered, lambda x: F.array_contains(_strings(index), x["item"]))
        named = lambda p: F.transform(places[p], lambda i: F.struct(F.lit(p).alias("item"), i.alias("pos")))
        hits = [indexed, *map(named, phrases)]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.when(some, F.array(*[F.struct(F.lit(label).alias("label"), places[p].alias("places")) for p, label in base.items()])).alias("base"),
            F.when(some, F.concat(*hits)).alias("hits"),
        )

    return let(words_of(text), lambda words: let(F.struct(words.alias("words"), F.array_intersect(words, looked_up).alias("present")), measure))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Mapping[str, str] = BASE_PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    Words are runs of digits, letters a-z and characters beyond ASCII, after A-Z became a-z.
    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the
    least and the greatest of them (null without any), ``base_labels`` their labels. ``labels``
    adds those of the accepted templates; both are sorted, distinct and joined by commas, empty
    without any. ``score`` is 1 where a base phrase stands, else the greatest share of the
    indexed weight of an accepted template that was found at one relative position, else 0.

    A null text counts as empty: no words, no labels. Repeated rows are judged one by one and
    alike, null ids are carried along, other columns are not read. An empty table gives an
    empty one. Words of equal document frequency are indexed in alphabetical order.
    """
    spark = docs.sparkSession
    weights = word_weights(docs, templates)
    postings = _postings(templates, weights)
    index = sorted({item for item, *_, phrase in postings if not phrase})
    phrases = sorted({item for item, *_, phrase in postings if phrase})

    measured = _measured(F.col("text"), base, index, phrases, weights)
    places = F.flatten(F.transform("m.base", lambda b: b["places"]))
    labels = F.transform(F.filter("m.base", lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    rows = stored(
        docs.select("doc_id", measured.alias("m")).select(
            "doc_id", F.monotonically_increasing_id().alias("row"), "m.n_words", F.coalesce(F.size(places).cast("long"), F.lit(0)).alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
            F.coalesce(labels, F.array().cast("array<string>")).alias("base"), F.col("m.hits").alias("hits"),
        )
    )

    numbers = range(len(templates))
    total = {n: sum({item: w for item, t, _, w, phrase in postings if t == n and not phrase}.values()) for n in numbers}
    # The index is as large as the templates, whatever the corpus: it is broadcast.
    index_table = F.broadcast(_table(spark, postings, ["item", "template", "place", "weight", "phrase"]))
    notices = F.broadcast(_table(spark, [(n, templates[n].label, total[n], len(templates[n].phrases)) for n in numbers], ["template", "label", "total", "needed"]))
    bin_ = F.floor((F.col("pos") - F.col("place")) / BAND)
    votes = (
        rows.select("row", F.inline("hits")).join(index_table, "item")
        .select("row", "template", F.struct("item", "weight", "phrase").alias("vote"), F.explode(F.array(bin_, bin_ - 1)).alias("bin"))
    )
    # Distinct items of one template: a bounded set.
    aligned = votes.groupBy("row", "template", "bin").agg(F.collect_set("vote").alias("votes")).join(notices, "template")
    weight = F.aggregate("votes", F.lit(0), lambda total, vote: total + vote["weight"])
    judged = aligned.select("row", "label", (weight / F.col("total")).alias("share"), F.size(F.filter("votes", lambda v: v["phrase"])).alias("n_phrases"), "needed")
    accepted = judged.filter((F.col("n_phrases") == F.col("needed")) & (F.col("share") >= LEAST_SHARE))
    found = accepted.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    every = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return rows.drop("hits").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )

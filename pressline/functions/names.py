"""Entity-name columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressline.functions.text import squash

# --- fixed values: words that are not part of a name ---
PERSON_TITLES = [
    "president", "vice president", "gen", "general", "maj gen", "lt gen", "brig", "capt",
    "hon", "rt hon", "dr", "mr", "mrs", "ms", "prof", "minister",
]
ORGANIZATION_PREFIXES = ["the"]
ORGANIZATION_SUFFIXES = ["ltd", "limited", "inc", "plc", "llc", "corp", "corporation", "company"]


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


LEADING_TITLES = rf"^(?:(?:{_any(PERSON_TITLES)})\s+)+"
LEADING_ARTICLES = rf"^(?:(?:{_any(ORGANIZATION_PREFIXES)})\s+)+"
TRAILING_FORMS = rf"(?:\s+(?:{_any(ORGANIZATION_SUFFIXES)}))+$"


def clean_entity_name(name: Column) -> Column:
    return squash(name)


def normalize_entity_name(name: Column, entity_type: Column) -> Column:
    """Comparison form of a name; titles and company forms are removed repeatedly."""
    # lower() keeps the sharp s; the comparison form folds it like the other letters.
    value = F.replace(F.lower(clean_entity_name(name)), F.lit("ß"), F.lit("ss"))
    value = F.replace(value, F.lit("&"), F.lit(" and "))
    value = F.regexp_replace(value, "[’']", "")
    value = F.trim(F.regexp_replace(value, r"[^a-z0-9]+", " "))
    person = F.regexp_replace(value, LEADING_TITLES, "")
    organization = F.regexp_replace(F.regexp_replace(value, LEADING_ARTICLES, ""), TRAILING_FORMS, "")
    return (
        F.when(entity_type == "person", person).when(entity_type == "organization", organization).otherwise(value)
    )


def entity_alias_keys(name: Column, entity_type: Column) -> Column:
    """Comparison keys of a name; 'X of Y' and 'Y X' meet for organizations."""
    base = normalize_entity_name(name, entity_type)
    parts = F.split(base, " ")
    swapped = F.when(
        (F.size(parts) == 3) & (F.get(parts, F.lit(1)) == "of"),
        F.concat_ws(" ", F.get(parts, F.lit(2)), F.get(parts, F.lit(0))),
    ).when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(1)), F.lit(" of "), F.get(parts, F.lit(0))))
    both = F.array_distinct(F.array_compact(F.array(base, swapped)))
    keys = F.when(entity_type == "organization", both).otherwise(F.array(base))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(keys)

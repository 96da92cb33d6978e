"""String, hash and display columns."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pressline.functions.binding import let

# --- fixed values: replacement tables, applied in this order ---
ESCAPED_CODE_POINTS = [
    ("\\u2018", "'"),
    ("\\u2019", "'"),
    ("\\u201c", '"'),
    ("\\u201d", '"'),
    ("\\u2013", "-"),
    ("\\u2014", "-"),
    ("\\u2026", "..."),
    ("\\xa0", " "),
]
MOJIBAKE = [
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("â€¦", "..."),
    ("Â ", " "),
    ("Â", ""),
]
SINGLE_QUOTES = "‘’‚‛′`´"
DOUBLE_QUOTES = "“”„″"
DASHES = "–—−"
ELLIPSIS = "…"
HARD_SPACE = "\u00a0"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

# Whitespace as a Unicode-aware class, both for Spark and for SQL engines using RE2.
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


@F.pandas_udf(T.StringType())
def _unescape_entities(values: pd.Series) -> pd.Series:
    def decode(text):
        if text is None:
            return None
        for _ in range(5):
            plain = html.unescape(text)
            if plain == text:
                break
            text = plain
        return text

    return values.map(decode, na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda text: unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii"),
        na_action="ignore",
    )


def unescape_html(text: Column) -> Column:
    """Decode HTML entities, up to five nested levels.

    Only rows that hold an ampersand are sent to Python; the rest stay in the JVM.
    """
    needs = text.contains("&")
    return F.when(needs, _unescape_entities(F.when(needs, text))).otherwise(text)


def ascii_fold(text: Column) -> Column:
    """Drop accents and other non-ASCII; only non-ASCII rows are sent to Python."""
    needs = text.rlike(r"[^\x00-\x7F]")
    return F.when(needs, _ascii_fold(F.when(needs, text))).otherwise(text)


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace on both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), f"{WS}+$", "")


def one_blank(text: Column) -> Column:
    """Whitespace runs as one blank; a run that is one blank already is not touched."""
    return F.regexp_replace(text, f" {WS}+|(?! ){WS}+", " ")


def squash(text: Column) -> Column:
    """Collapse whitespace runs to one blank and strip."""
    return strip(one_blank(F.coalesce(text, F.lit(""))))


def _replaced(text: Column, table: list[tuple[str, str]]) -> Column:
    for bad, good in table:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def _if(text: Column, test: Column, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` for rows that need it: one look at a text is cheaper than many replacements."""
    return F.when(test, change(text)).otherwise(text)


_TYPOGRAPHIC = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + HARD_SPACE
_PLAIN = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " "

_MARKED = "[`\u00a0\u00b4\u2000-\u22ff\ufeff]"  # few ranges that hold all marks: quick to test


def _plain_marks(text: Column) -> Column:
    dotted = F.replace(text, F.lit(ELLIPSIS), F.lit("..."))
    return F.translate(dotted, _TYPOGRAPHIC + ZERO_WIDTH, _PLAIN)


def clean_text(text: Column, preserve_paragraphs: bool = True) -> Column:
    """Readable article text from scraped text.

    Every step first looks whether a text holds what it replaces; most texts hold nothing of it.
    """
    raw = F.coalesce(text, F.lit(""))
    escaped = _if(raw, raw.contains("\\"), lambda t: _replaced(t, ESCAPED_CODE_POINTS))
    needs = raw.contains("&")  # the replacements so far neither add nor take an ampersand
    decoded = F.when(needs, _unescape_entities(F.when(needs, escaped))).otherwise(escaped)
    out = let(decoded, lambda t: _if(t, t.rlike("[\u00e2\u00c2]"), lambda u: _replaced(u, MOJIBAKE)))
    out = let(out, lambda t: _if(t, t.rlike(_MARKED), _plain_marks))
    out = F.regexp_replace(out, r"[\t\f\x0B][ \t\f\x0B]*| [ \t\f\x0B]+", " ")
    if preserve_paragraphs:
        out = F.regexp_replace(out, r" *(?:\r\n|\r|\n) *", "\n")
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    else:
        out = one_blank(out)
    return strip(out)


def normalize_title(title: Column) -> Column:
    """Lower-case words, Unicode-aware."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    return squash(F.regexp_replace(lowered, r"[^\p{L}\p{N}_\s]", " "))


def hash_text(text: Column) -> Column:
    """T4: SHA-256 of the stripped text, '' when blank."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.lit("")).otherwise(F.sha2(bare, 256))


def bounded_identifier(value: Column, max_length: int = 120) -> Column:
    """T5: the cleaned value, or its head plus a short SHA-1 when it is too long."""
    clean = clean_text(value, preserve_paragraphs=False)
    short = F.substring(clean, 1, max_length - 17)
    digest = F.substring(F.sha1(clean), 1, 16)
    return F.when(F.length(clean) <= max_length, clean).otherwise(F.concat(short, F.lit("-"), digest))


def slugify(text: Column, max_length: int = 200) -> Column:
    """ASCII, lower-case, hyphen-joined."""
    folded = F.lower(ascii_fold(F.coalesce(text, F.lit(""))))
    kept = F.trim(F.regexp_replace(folded, r"[^a-z0-9_\s-]", ""))
    joined = F.regexp_replace(kept, r"[-\s]+", "-")
    return F.substring(F.regexp_replace(joined, r"^[-_]+|[-_]+$", ""), 1, max_length)


def video_slug(title: Column, video_id: Column) -> Column:
    return F.concat(slugify(title, 50), F.lit("-"), F.substring(video_id.cast("string"), 1, 8))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def paragraph_count(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.filter(F.split(body, "\n\n"), lambda p: strip(p) != "")))


def read_minutes(count: Column) -> Column:
    """200 words per minute, at least one minute for any text, 0 for none."""
    whole = F.floor(count / 200).cast("int")
    return F.when(count > 0, F.greatest(F.lit(1), whole)).otherwise(F.lit(0))


def event_date(published_at: Column, scraped_at: Column, as_of: Column) -> Column:
    """T9."""
    return F.coalesce(published_at, scraped_at, as_of)


def age_hours(ts: Column, as_of: Column) -> Column:
    """Age in fractional hours."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(3.6e9)


def truncate_words(text: Column, limit: int = 450) -> Column:
    """At most ``limit`` words, '...' when something was cut."""
    parts = words(text)
    cut = F.concat(F.array_join(F.slice(parts, 1, limit), " "), F.lit("..."))
    return F.when(F.size(parts) <= limit, text).otherwise(cut)


def shorten(text: Column, max_length: int, suffix: str = "…") -> Column:
    """Cut at ``max_length`` characters including the suffix."""
    head = F.rtrim(F.substring(text, 1, max_length - len(suffix)))
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(head, F.lit(suffix)))


def _cut_at_word(chunk: Column) -> Column:
    """Drop the last, possibly broken, word and add an ellipsis."""
    at_blank = F.regexp_extract(chunk, r"(?s)^(.+) [^ ]*$", 1)
    return F.concat(F.rtrim(F.when(at_blank != "", at_blank).otherwise(chunk)), F.lit("…"))


def shorten_to_sentence(text: Column, max_length: int, lookback: int = 120) -> Column:
    """Cut at the last sentence end found in the final ``lookback`` characters."""
    chunk = F.substring(text, 1, max_length)
    ended = F.regexp_extract(chunk, r"(?s)^(.+[.!?])(?=[ \n]|$)", 1)
    recent = (ended != "") & (F.length(ended) > F.greatest(F.lit(1), F.length(chunk) - lookback + 1))
    return (
        F.when(F.length(text) <= max_length, text)
        .when(recent, F.rtrim(ended))
        .otherwise(_cut_at_word(chunk))
    )


def first_sentences(text: Column, max_length: int, count: int = 2) -> Column:
    """The first ``count`` sentences, cut at a word when still too long."""
    bare = strip(text)
    parts = F.filter(F.split(bare, r"(?<=[.!?])(?=[ \n])"), lambda s: strip(s) != "")
    joined = F.array_join(F.transform(F.slice(parts, 1, count), strip), " ")
    return F.when(F.length(joined) <= max_length, joined).otherwise(
        _cut_at_word(F.substring(joined, 1, max_length))
    )


def pack_sentences(text: Column, max_length: int) -> Column:
    """Sentences packed greedily into chunks of at most ``max_length`` characters.

    A sentence longer than the limit stays whole in its own chunk.
    """
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    parts = F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, sentence):
        fits = F.length(acc["open"]) + 1 + F.length(sentence) <= max_length
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), sentence.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), sentence).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), sentence.alias("open")))
        )

    def finish(acc):
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(parts, empty, step, finish)


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def tag_entities(text: Column, entities: Column, href: str = "/stories/?q=") -> Column:
    """Wrap entity names in links, longest name first.

    ``entities`` is ``array<struct<name, type>>``. Names are first swapped for
    placeholders, so a short name never splits a longer one.
    """
    valid = F.filter(entities, lambda e: (F.coalesce(e["name"], F.lit("")) != "") & (F.coalesce(e["type"], F.lit("")) != ""))
    numbered = F.transform(valid, lambda e, i: F.struct((-F.length(e["name"])).alias("rank"), i.alias("pos"), e["name"].alias("name"), e["type"].alias("type")))
    ordered = F.array_sort(numbered)  # struct order: longest name first, then position

    def token(e):
        return F.concat(F.lit("\x01E"), e["pos"].cast("string"), F.lit("\x01"))

    def link(e):
        query = F.replace(F.url_encode(e["name"]), F.lit("+"), F.lit("%20"))
        return F.concat(
            F.lit('<a class="entity entity-'), e["type"], F.lit(f'" href="{href}'), query, F.lit('">'),
            escape_html(e["name"]), F.lit("</a>"),
        )

    body = escape_html(F.coalesce(text, F.lit("")))
    marked = F.aggregate(ordered, body, lambda acc, e: F.replace(acc, escape_html(e["name"]), token(e)))
    return F.coalesce(F.aggregate(ordered, marked, lambda acc, e: F.replace(acc, token(e), link(e))), body)


def clock(seconds: Column, pad_hours: bool = False) -> Column:
    """``h:mm:ss`` / ``m:ss``, or the zero-padded form used on video pages."""
    total = F.floor(F.coalesce(seconds.cast("double"), F.lit(0.0))).cast("long")
    total = F.when(total < 0, F.lit(0)).otherwise(total)
    hours, minutes, secs = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    long_form, short_form = ("%02d:%02d:%02d", "%02d:%02d") if pad_hours else ("%d:%02d:%02d", "%d:%02d")
    return F.when(hours > 0, F.format_string(long_form, hours, minutes, secs)).otherwise(
        F.format_string(short_form, minutes, secs)
    )


def theme_label(theme: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(theme, F.lit("")), F.lit("_"), F.lit(" ")))


def excerpt(text: Column, limit: int = 220) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)


def time_ago(ts: Column, as_of: Column) -> Column:
    """The largest unit and the next smaller one, e.g. '1 day, 3 hours'."""
    start, now = ts.cast("timestamp"), as_of.cast("timestamp")
    months = F.greatest(F.lit(0), F.floor(F.months_between(now, start, False)).cast("int"))
    pivot = start + F.make_ym_interval(F.lit(0), months)
    minutes = F.greatest(F.lit(0), F.floor(age_hours(pivot, now) * 60 + F.lit(1e-9)).cast("long"))
    units = [
        ("year", F.floor(months / 12)),
        ("month", months % 12),
        ("week", F.floor(minutes / 10080)),
        ("day", F.floor(minutes % 10080 / 1440)),
        ("hour", F.floor(minutes % 1440 / 60)),
        ("minute", minutes % 60),
    ]

    def label(name, amount):
        return F.concat(amount.cast("long").cast("string"), F.lit(f" {name}"), F.when(amount == 1, F.lit("")).otherwise(F.lit("s")))

    out = F.lit("0 minutes")
    for i in reversed(range(len(units))):
        name, amount = units[i]
        text = label(name, amount)
        if i + 1 < len(units):
            smaller, rest = units[i + 1]
            text = F.when(rest > 0, F.concat(text, F.lit(", "), label(smaller, rest))).otherwise(text)
        out = F.when(amount > 0, text).otherwise(out)
    return F.when(start >= now, F.lit("0 minutes")).otherwise(out)


def title_case(name: Column) -> Column:
    """T16."""
    return F.initcap(name)


def next_send_at(scheduled_minutes: Column, as_of: Column) -> Column:
    """The next daily slot strictly after ``as_of``."""
    midnight = F.date_trunc("day", as_of)
    slot = midnight + F.make_dt_interval(mins=scheduled_minutes.cast("int"))
    return F.when(as_of < slot, slot).otherwise(slot + F.expr("INTERVAL 1 DAY"))

"""Documents: hashes, gates, counts, chunks, excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of pages that check for robots.
CHALLENGE_MARKERS = (
    "performing security verification",
    "checking your browser",
    "enable javascript and cookies to continue",
    "verify you are human",
    "verifying you are human",
    "ddos protection by",
    "attention required! | cloudflare",
    "please enable cookies",
    "request unsuccessful. incapsula",
    "why have i been blocked",
)
PAGE_MARKER = r"<!--\s*page:(\d+)\s*-->"
CHUNK_TOKENS, OVERLAP_TOKENS, TOKENS_PER_WORD = 450, 50, 1.3


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends too."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text).cast("binary"), 256)


def has_any(text: Column, markers) -> Column:
    """True where a text holds one of the markers: one pattern, so that the text is worked out once."""
    return F.coalesce(text.rlike("|".join(re.escape(m) for m in markers)), F.lit(False))


def looks_like_challenge(text: Column) -> Column:
    return has_any(F.lower(F.left(text, F.lit(2000))), CHALLENGE_MARKERS)


def split_words(text: Column) -> Column:
    body = strip(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def rough_tokens(n_words: Column) -> Column:
    """About how many tokens so many words make, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n_words * F.lit(TOKENS_PER_WORD)).cast("int"))


def shorten(text: Column, width: int = 400) -> Column:
    """Single spaces; if longer than ``width``, whole words and an ellipsis within it."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.trim(F.regexp_extract(F.concat(flat, F.lit(" ")), rf"^(.{{0,{width - 1}}})(?=\s)", 1))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(cut, F.lit("…")))


def chunk_arrays(text: Column, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Overlapping runs of words: array of (text, token_count); the last one ends with the text."""
    per_chunk = max(1, int(tokens / TOKENS_PER_WORD))
    shared = max(0, int(overlap / TOKENS_PER_WORD))
    step = max(1, per_chunk - shared)

    def cut(found: Column) -> Column:
        n = F.size(found)
        last = F.when(n <= per_chunk, 0).otherwise(F.ceil((n - per_chunk) / step)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(found, k * step + 1, per_chunk))
        chunks = F.transform(parts, lambda p: F.struct(F.array_join(p, " ").alias("text"), rough_tokens(F.size(p)).alias("token_count")))
        return F.when(n > 0, chunks).otherwise(F.slice(chunks, 1, 0))

    # The words are bound once: read inside the lambda of chunks, the text would be split again for each chunk.
    return F.get(F.transform(F.array(split_words(text)), cut), F.lit(0))


def page_sections(text: Column) -> Column:
    """The parts of a text after page markers: array of (page, text), empty ones left out; text before the first is dropped.

    A text without markers is page 1.
    """
    pages = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(1))
    bodies = F.transform(F.split(text, PAGE_MARKER), strip)
    marked = F.transform(F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), lambda b, i: F.struct(pages[i].cast("int").alias("page"), b.alias("text")))
    plain = F.array(F.struct(F.lit(1).alias("page"), strip(text).alias("text")))
    return F.filter(F.when(F.size(pages) > 0, marked).otherwise(plain), lambda s: s["text"] != "")


def firm_card(name: Column, firm_type: Column, asset_classes: Column, localities: Column, focus_areas: Column, description: Column) -> Column:
    """A firm in a few words, for embedding."""
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    listed = lambda c, n=None: F.nullif(F.array_join(c if n is None else F.slice(c, 1, n), ", "), F.lit(""))
    return F.concat_ws(
        ". ",
        name,
        F.when(firm_type != "unknown", F.nullif(spaced(firm_type), F.lit(""))),
        spaced(listed(asset_classes)),
        listed(localities, 5),
        listed(focus_areas, 4),
        F.nullif(shorten(description), F.lit("")),
    )


def money(amount: Column) -> Column:
    """Whole dollars with thousands apart."""
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def day_label(ts: Column) -> Column:
    """Like "Jan 5"; "recent" where there is no date."""
    return F.coalesce(F.date_format(ts, "MMM d"), F.lit("recent"))


def normalize_whitespace(text: Column) -> Column:
    """For PDF text: no soft hyphens, ligatures undone, single spaces, two line ends at most."""
    for old, new in (("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def dehyphenate(text: Column) -> Column:
    """Words that a line end broke, made whole."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")

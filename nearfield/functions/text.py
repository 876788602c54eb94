"""Text helpers as Column expressions.

Lengths and positions count Unicode code points.  Whitespace means the set
below everywhere (regex ``\\s`` and ``trim`` differ between engines, so neither
is used).
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of ECMAScript's \s and trim().
WHITESPACE = (
    "\t\n\v\f\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a character class both Java and Python regexes read alike.
WHITESPACE_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]"

# Sizing rules and limits of the chunking and embedding requests.
CHARS_PER_TOKEN = 4
DEFAULT_CHUNK_TOKENS = 400
DEFAULT_OVERLAP_PERCENT = 15
DEFAULT_MIN_CHARS = 50
DEFAULT_MAX_TOKENS = 8000


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: a quarter of the length, rounded up."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def tokens_to_chars(tokens: int) -> int:
    return tokens * CHARS_PER_TOKEN


def clean_text(text: Column) -> Column:
    """Unix line ends, at most one blank line in a row, single spaces, trimmed.

    Plain substring tests spare most texts the regex passes.
    """

    def has(*parts: str) -> Column:
        return reduce(operator.or_, [F.contains(text, F.lit(part)) for part in parts])

    unix = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.when(has("\r", "\n\n\n"), F.regexp_replace(unix, "\n{3,}", "\n\n")).otherwise(text)
    spaced = F.when(has("\t", "  "), F.regexp_replace(lines, "[ \t]+", " ")).otherwise(lines)
    return trim(spaced)


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text; looks no further than the first other character."""
    return ~F.coalesce(F.rlike(text, F.lit("[^" + WHITESPACE_CLASS[1:])), F.lit(False))


def usable_text(text: Column) -> Column:
    """True for a text that a sync takes: present and not empty (blank is fine)."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def validation_reason(text: Column, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """NULL for a text that may be embedded, else why not."""
    tokens = token_estimate(text)
    return F.when(is_blank(text), F.lit("Text is empty")).when(
        tokens > max_tokens,
        F.concat(
            F.lit("Text too long: ~"), tokens.cast("string"), F.lit(f" tokens (max: {max_tokens})")
        ),
    )


def sentences(text: Column) -> Column:
    """Array of sentences: cut at whitespace after ``.``, ``!`` or ``?``; blanks dropped."""
    pieces = F.split(text, f"(?<=[.!?]){WHITESPACE_CLASS}+")
    return F.filter(pieces, lambda piece: ~is_blank(piece))


def file_extension(name: Column) -> Column:
    """Lower-cased part after the last dot (the whole name where there is none)."""
    return F.lower(F.element_at(F.split(name, "\\."), -1))


def name_uuid(*parts: Column) -> Column:
    """A UUID-shaped id derived from ``parts``, equal on every run."""
    digest = F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-3"),
        F.substring(digest, 14, 3),
        F.lit("-a"),
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def labelled_values(names: list[str], separator: str) -> Column:
    """``name: value`` for every column in turn; a missing value shows as empty."""
    cells = [
        F.concat(F.lit(f"{name}: "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        for name in names
    ]
    return F.concat_ws(separator, *cells)

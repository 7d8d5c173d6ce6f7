"""Text cleaning and tokenising, as JVM column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python calls white space. Java's and RE2's own "\s" are ASCII
# only, so the class is spelled out; the text is a valid class body in both engines.
BLANK_CODES = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
BLANKS = "".join(map(chr, BLANK_CODES))
SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = f"http[^{SPACE}]+|www[^{SPACE}]+"
TAG_PATTERN = r"<[^>\n]*>"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
INK_PATTERN = f"[^{SPACE}]"
# printable ASCII is ruled out first: that halves the time of the long class
SPACES_PATTERN = f"(?![!-~])[{SPACE}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space; null stays null."""
    return F.btrim(_col(c), F.lit(BLANKS))


def has_text(c: Column | str) -> Column:
    """True where ``strip`` leaves something; stops at the first character that is not blank."""
    return _col(c).rlike(INK_PATTERN)


def clean_text(c: Column | str) -> Column:
    """Strip, delete links and tags, collapse white space; an empty result becomes null.

    There is no second strip: a link at the end leaves the blank that stood before it.
    """
    def unlink(t: Column) -> Column:
        return F.when(t.contains("http") | t.contains("www"), F.regexp_replace(t, URL_PATTERN, "")).otherwise(t)

    def untag(t: Column) -> Column:
        return F.when(t.contains("<"), F.regexp_replace(t, TAG_PATTERN, "")).otherwise(t)

    plain = bind(bind(strip(c), unlink), untag)
    return F.nullif(F.regexp_replace(plain, SPACES_PATTERN, " "), F.lit(""))


def clean_minimal(c: Column | str) -> Column:
    """Strip only, with null turned into the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def whitespace_tokens(c: Column | str) -> Column:
    """Lower-cased tokens between runs of white space."""
    return F.array_remove(F.split(F.lower(_col(c)), SPACES_PATTERN), "")


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), F.lit(0))


def with_bigrams(tokens: Column | str) -> Column:
    """The tokens followed by each pair of neighbours joined with one blank."""

    def extend(own: Column) -> Column:
        pairs = F.greatest(F.size(own) - 1, F.lit(0))
        left, right = F.slice(own, 1, pairs), F.slice(own, 2, pairs)
        return F.concat(own, F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b)))

    return bind(_col(tokens), extend)

"""Label parsing, interpretation and arg-max, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentiment classes and the label words accepted for each of them.
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2
CLASSES = (NEGATIVE, NEUTRAL, POSITIVE)
LABEL_WORDS = {
    "negativno": 0,
    "negative": 0,
    "neg": 0,
    "0": 0,
    "neutralno": 1,
    "neutral": 1,
    "neu": 1,
    "1": 1,
    "pozitivno": 2,
    "positive": 2,
    "poz": 2,
    "2": 2,
}

# Upper bounds (inclusive) of the agreement bands.
KAPPA_BANDS = (
    (0.20, "Slight agreement"),
    (0.40, "Fair agreement"),
    (0.60, "Moderate agreement"),
    (0.80, "Substantial agreement"),
)
KAPPA_BELOW_ZERO = "No agreement"
KAPPA_ABOVE_BANDS = "Almost perfect agreement"
KAPPA_UNDEFINED = "Undefined"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_label(c: Column | str, strict: bool = True) -> Column:
    """Map a label word or digit to its class; unknown words raise, or give null if not strict."""
    from labelloom.functions.text import strip

    word = F.lower(strip(_col(c).cast("string")))
    words = F.create_map(*[F.lit(v) for v in chain.from_iterable(LABEL_WORDS.items())])
    hit = F.try_element_at(words, word)
    if not strict:
        return hit
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(word, F.lit("null"))))
    return F.coalesce(hit, unknown.cast("int"))


def numeric(c: Column | str) -> Column:
    """Lenient number parsing: whatever is not a number becomes null."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def int_label(c: Column | str) -> Column:
    """Lenient integer label: parsed as a number, then truncated towards zero."""
    return numeric(c).try_cast("int")


def interpret_kappa(k: Column | str) -> Column:
    """The agreement band of a kappa value; null and NaN are undefined."""
    k = _col(k)
    out = F.when(k.isNull() | F.isnan(k), KAPPA_UNDEFINED).when(k < 0, KAPPA_BELOW_ZERO)
    for upper, name in KAPPA_BANDS:
        out = out.when(k <= upper, name)
    return out.otherwise(KAPPA_ABOVE_BANDS)


def argmax(scores: Column | str) -> Column:
    """Zero-based position of the largest score; the first one wins a tie."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

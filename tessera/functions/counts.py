"""Lenient parsing of reported counts and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal literal as a Python float() accepts it: optional sign, digits with
# single underscores between them, optional fraction and exponent.
_DECIMAL = r"^[+-]?(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters stripped around a reported value (ASCII whitespace).
_WHITESPACE = " \t\n\r\x0b\x0c"


def normalize_count(value) -> Column:
    """Reported count -> integer count.

    NULL, blank, ``X``/``x`` and anything that is not a decimal number give 1
    (a bare presence report); a number is truncated toward zero.  Numeric
    inputs go through their string form, so the rule is the same for both.
    ``nan``/``inf`` and values beyond the 64-bit range also give 1.

    Fast path: a plain integer of up to 15 characters (exact as a double) is
    cast directly; only other strings meet the decimal-syntax regex.
    """
    s = F.btrim(_c(value).cast("string"), F.lit(_WHITESPACE))
    plain = F.when(F.length(s) <= 15, s.try_cast("bigint"))
    number = F.replace(s, F.lit("_"), F.lit("")).try_cast("double").try_cast("bigint")
    one = F.lit(1).cast("bigint")
    return (
        F.when(s.isNull() | (s == "") | (F.upper(s) == "X"), one)
        .otherwise(F.coalesce(
            plain,
            F.when(s.rlike(_DECIMAL), F.coalesce(number, one)).otherwise(one),
        ))
    )


def lenient_timestamp(value) -> Column:
    """String -> TIMESTAMP_NTZ, wall clock kept, any zone suffix dropped,
    unparsable -> NULL.  Each value is parsed on its own."""
    return _c(value).cast("string").try_cast("timestamp_ntz")

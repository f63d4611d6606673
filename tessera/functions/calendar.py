"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON_PERIOD_WEEKS = 52.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_week(date) -> Column:
    """ISO-8601 week number (1..53) of a date or timestamp."""
    return F.weekofyear(_c(date))


def calendar_year(date) -> Column:
    """Calendar year of a date.  Paired with the ISO week on purpose: the
    covariate keys keep (calendar year, ISO week), so 1 Jan may share a key
    with the last days of December of the same calendar year."""
    return F.year(_c(date))


def week_sin(week) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * _c(week) / F.lit(SEASON_PERIOD_WEEKS))


def week_cos(week) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * _c(week) / F.lit(SEASON_PERIOD_WEEKS))

"""Post-scoring rules and display conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.dims import NORTHERN_STATES

# ---------------------------------------------------------------------------
# FIXED VALUES (texts and cut points of the original rules)
# ---------------------------------------------------------------------------
BAND_LOW = "Low likelihood"
BAND_EMERGING = "Emerging signal"
BAND_LIKELY = "Likely present"
BAND_STRONG = "Strong presence signal"
BAND_CUTS = (0.30, 0.60, 0.80)

ARRIVAL_NOW = "Likely present now"
ARRIVAL_1_2 = "Likely within 1–2 weeks"
ARRIVAL_2_3 = "Possible arrival within 2–3 weeks"
ARRIVAL_3_4 = "Possible arrival within 3–4 weeks"
ARRIVAL_NONE = "No strong arrival signal yet"
ARRIVAL_CUTS = (0.5, 0.4, 0.3)

NORTHERN_WARNING = (
    "Caution: this is a northern-state prediction with limited recent local activity. "
    "This may indicate early reports rather than broad statewide presence."
)
NORTHERN_MIN_PROBABILITY = 0.8
NORTHERN_MIN_LOCAL = 5

LABEL_PRESENT = "Present"
LABEL_ABSENT = "Not Present"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interpret_probability(p) -> Column:
    p = _c(p)
    lo, mid, hi = BAND_CUTS
    return (F.when(p < lo, BAND_LOW).when(p < mid, BAND_EMERGING)
            .when(p < hi, BAND_LIKELY).otherwise(BAND_STRONG))


def arrival_window(p, corridor_last_7d, local_last_7d) -> Column:
    p, corr, loc = _c(p), _c(corridor_last_7d), _c(local_last_7d)
    now, soon, maybe = ARRIVAL_CUTS
    return (
        F.when(p >= now, ARRIVAL_NOW)
        .when(p >= soon, ARRIVAL_1_2)
        .when(p >= maybe, F.when((corr > 0) | (loc > 0), ARRIVAL_2_3).otherwise(ARRIVAL_NONE))
        .when(corr > 0, ARRIVAL_3_4)
        .otherwise(ARRIVAL_NONE)
    )


def _northern_caution(state, p, local_last_7d, northern=None) -> Column:
    northern = NORTHERN_STATES if northern is None else northern
    return (_c(state).isin(list(northern)) & (_c(p) >= NORTHERN_MIN_PROBABILITY)
            & (_c(local_last_7d) < NORTHERN_MIN_LOCAL))


def migration_warning(state, p, local_last_7d, northern=None) -> Column:
    return F.when(_northern_caution(state, p, local_last_7d, northern), F.lit(NORTHERN_WARNING))


def adjusted_interpretation(state, p, local_last_7d, northern=None) -> Column:
    return F.when(_northern_caution(state, p, local_last_7d, northern), F.lit(BAND_EMERGING))


def prediction_label(prediction) -> Column:
    return F.when(_c(prediction) == 1, LABEL_PRESENT).otherwise(LABEL_ABSENT)


def final_interpretation(adjusted, interpretation) -> Column:
    return F.coalesce(_c(adjusted), _c(interpretation))


def c_to_f(c) -> Column:
    return _c(c) * 9.0 / 5.0 + 32.0


def mm_to_in(mm) -> Column:
    return _c(mm) / 25.4


def kmh_to_mph(kmh) -> Column:
    return _c(kmh) * 0.621371


def percent_text(p, digits: int = 1) -> Column:
    """Display text of a probability, e.g. 0.4567 -> '45.7%'."""
    return F.concat(F.format_number(_c(p) * 100.0, digits), F.lit("%"))


def fixed_text(x, digits: int = 1) -> Column:
    """Display text with ``digits`` decimals and thousands separators."""
    return F.format_number(_c(x), digits)

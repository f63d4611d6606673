"""Column expressions (JVM-side, codegen-friendly) used by the operators."""

from tessera.functions.calendar import calendar_year, iso_week, week_cos, week_sin
from tessera.functions.counts import lenient_timestamp, normalize_count
from tessera.functions.rules import (
    arrival_window,
    c_to_f,
    final_interpretation,
    interpret_probability,
    kmh_to_mph,
    migration_warning,
    adjusted_interpretation,
    fixed_text,
    mm_to_in,
    percent_text,
    prediction_label,
)

__all__ = [
    "calendar_year", "iso_week", "week_sin", "week_cos",
    "lenient_timestamp", "normalize_count",
    "interpret_probability", "arrival_window", "migration_warning", "adjusted_interpretation",
    "prediction_label", "final_interpretation", "c_to_f", "mm_to_in", "kmh_to_mph", "percent_text", "fixed_text",
]

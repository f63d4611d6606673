"""History and season features over the panel (B5: W2-W5, F6, F8).

All windows are clustered on (entity, region) and ordered by (year, week):
a window partition holds years x weeks rows (bounded by the calendar), and
the exchange that built the panel already clusters the rows that way, so
these columns add a sort at most, never a shuffle.  Lags cross year
boundaries on purpose: the first week of a season looks back to the last
panel week of the year before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.calendar import week_cos, week_sin


def add_history(panel: DataFrame, keys=("species", "stateProvince"), order=("year", "week_of_year"),
                value: str = "obs_count", week: str = "week_of_year") -> DataFrame:
    """Adds lag_1..3_<value>, rolling_2wk/3wk_mean_<value> (mean of the
    previous 2/3 rows), rolling_4wk_max_<value> (max of the previous 4 rows),
    week_sin, week_cos and had_recent_activity (lag 1 or lag 2 > 0)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.col(value)
    lag1 = F.lag(v, 1).over(w)
    lag2 = F.lag(v, 2).over(w)
    out = panel.select(
        "*",
        lag1.alias(f"lag_1_{value}"),
        lag2.alias(f"lag_2_{value}"),
        F.lag(v, 3).over(w).alias(f"lag_3_{value}"),
        F.avg(v).over(w.rowsBetween(-2, -1)).alias(f"rolling_2wk_mean_{value}"),
        F.avg(v).over(w.rowsBetween(-3, -1)).alias(f"rolling_3wk_mean_{value}"),
        F.max(v).over(w.rowsBetween(-4, -1)).alias(f"rolling_4wk_max_{value}"),
        week_sin(week).alias("week_sin"),
        week_cos(week).alias("week_cos"),
    )
    recent = (F.coalesce(F.col(f"lag_1_{value}"), F.lit(0)) > 0) | (F.coalesce(F.col(f"lag_2_{value}"), F.lit(0)) > 0)
    return out.withColumn("had_recent_activity", recent.cast("int"))

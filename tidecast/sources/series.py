"""Ordinary tables -> regular series: (series_id, t, ts, y) with t dense from 1 and no gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = {"year": "interval 12 months", "quarter": "interval 3 months", "month": "interval 1 month", "week": "interval 7 days", "day": "interval 1 day", "hour": "interval 1 hour", "minute": "interval 1 minute"}


def series_from(table: DataFrame, series_id: str, ts: str, value: str, grain: str, trim: int = 0, exact: bool = False, fill: str = "zero", start: str = "common") -> DataFrame:
    """Sums of value by series and grain on a common calendar; the last `trim` steps are left out.

    exact: sum through decimal(18,2), so that the sum doesn't depend on the order of rows. fill: a missing step is 0 (zero), has the
    last value before it (forward; null before the first) or stops the job (error). start: every series begins with the
    calendar (common), or with its own first step (own), which then is t = 1. Weeks begin on Mondays. Null ids and times are left out.
    """
    if grain not in STEPS or fill not in ("zero", "forward", "error") or start not in ("common", "own"):
        raise ValueError(f"grain is one of {', '.join(STEPS)}; fill is zero, forward or error; start is common or own")
    stamp = F.date_trunc(grain, F.col(ts).cast("timestamp_ntz")).cast("timestamp_ntz")
    v = F.col(value).cast("decimal(18,2)") if exact else F.col(value)
    rows = table.select(F.col(series_id).alias("series_id"), stamp.alias("ts"), v.alias("v")).where("series_id is not null and ts is not null")
    sums = rows.groupBy("series_id", "ts").agg(F.sum("v").cast("double").alias("y"))
    firsts = sums.groupBy("series_id").agg(F.min("ts").alias("first"))
    # one row: the calendar's ends
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumn("one", F.lit(1))
    begin = "first" if start == "own" else "lo"
    calendar = F.expr(f"sequence({begin}, hi, {STEPS[grain]})")
    kept = F.slice(calendar, F.lit(1), F.greatest(F.size(calendar) - trim, F.lit(0)))
    spans = firsts.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one")
    grid = spans.select("series_id", F.posexplode(kept).alias("t", "ts")).withColumn("t", F.col("t") + 1)
    filled = {
        "zero": F.coalesce("y", F.lit(0.0)),
        "forward": F.last("y", True).over(Window.partitionBy("series_id").orderBy("t")),
        "error": F.coalesce("y", F.raise_error(F.concat(F.lit("no value of "), F.col("series_id").cast("string"), F.lit(" at "), F.col("ts").cast("string"))).cast("double")),
    }[fill]
    return grid.join(sums, ["series_id", "ts"], "left").select("series_id", "t", "ts", filled.alias("y"))

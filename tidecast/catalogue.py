"""Every registered query of the forecasting engine, and the SQL that gives the same rows."""

from __future__ import annotations

from tidecast.plans.checked import CHECKED
from tidecast.plans.ensembles import ENSEMBLES
from tidecast.plans.native import NATIVE, ar1_forecast
from tidecast.plans.streams import LEARNED, STREAMS

flagship = ar1_forecast


def queries() -> dict:
    return {name: run for name, (run, _) in (NATIVE | CHECKED | STREAMS).items()} | ENSEMBLES | LEARNED


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (NATIVE | CHECKED | STREAMS).items()}

"""Time-series operators in one place: tests, decomposition, models and forecasts."""

from __future__ import annotations

from statloom.operators.arima import fit_arima, fit_arima_model, forecast_time_series
from statloom.operators.decomposition import decompose_time_series, stl
from statloom.operators.stationarity import check_stationarity

__all__ = ["check_stationarity", "decompose_time_series", "fit_arima", "fit_arima_model", "forecast_time_series", "stl"]

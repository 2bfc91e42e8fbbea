"""Weekly demand forecasts for every store, product and horizon, on Spark."""

from shelfcast.config import ExportConfig, ForecastConfig
from shelfcast.plans.export_run import load_predictions, run_export
from shelfcast.plans.forecast_run import run_forecast

__all__ = ["ExportConfig", "ForecastConfig", "load_predictions", "run_export", "run_forecast"]

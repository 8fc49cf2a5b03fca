"""panelcast: revenue and demand forecasting over panels of time series, on Spark."""

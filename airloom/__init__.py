"""Hourly sensor series on Spark: cleaning, features, joins, quality, drift, forecasts, alerts."""

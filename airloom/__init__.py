"""Hourly air-quality analytics and forecasting as Spark DataFrame jobs."""

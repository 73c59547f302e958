"""Operators on DataFrames: retention, reviews, sales, stock, forecasts and workflow."""

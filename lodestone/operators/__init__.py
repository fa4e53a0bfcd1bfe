"""Operators: functions from DataFrames and settings to DataFrames."""

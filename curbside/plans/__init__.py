"""Analyses: functions from DataFrames to DataFrames."""

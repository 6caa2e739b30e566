"""Operators: functions from DataFrame to DataFrame with their parameters as keywords."""

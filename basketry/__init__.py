"""Recommendation and behaviour analytics over event logs, as Spark DataFrame functions."""

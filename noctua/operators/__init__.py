"""Operators: DataFrame-in, DataFrame-out building blocks of the incident jobs."""

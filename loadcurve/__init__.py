"""loadcurve: meter and sensor time-series analytics as Spark DataFrame operators.

Operators take DataFrames plus column names and return DataFrames; the caller owns the
session.  See README.md for the map from operator ids to functions.
"""

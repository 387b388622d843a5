"""Operators: functions from DataFrames to DataFrames.

"Now" is always an ``as_of`` argument.  Nothing here collects rows; the few operators that look at
sizes first collect one small aggregate and say so.
"""

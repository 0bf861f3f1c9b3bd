"""Palimpsest: a Spark-native engine for long-lived text memories.

Everything is a function from DataFrames (plus an explicit ``as_of`` and
parameters) to DataFrames.  Nothing here mutates state in place.
"""

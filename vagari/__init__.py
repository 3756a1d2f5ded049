"""vagari: a PySpark-native engine for vague spatial annotations.

Captions, boxes and scores are DataFrames; every relational step is declared
with the DataFrame or SQL API so that Catalyst plans it.
"""

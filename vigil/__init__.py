"""vigil — Spark-native data-quality, drift and feature engine.

Every operator is a function that takes DataFrames (plus plain Python
parameters) and returns a DataFrame.  Nothing row-sized passes through the
driver; per-row Python is limited to small helpers.
"""

__version__ = "0.1.0"

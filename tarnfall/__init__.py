"""Tarnfall: retrieval, graph and record-quality analytics as plain PySpark functions.

Public functions take DataFrames (or Columns) and return DataFrames (or Columns).
"""

__version__ = "0.1.0"

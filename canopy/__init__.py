"""Spark-native analytics over versioned, hierarchical content repositories.

A content tree is two strictly typed DataFrames (one row per node, one row per
property value) plus small catalogue tables; every operator is a function from
DataFrames to a DataFrame.  Importing the package never starts a session.
"""

__version__ = "0.1.0"

"""Spark-native graph representation analytics.

Graphs are edge DataFrames, walks are long DataFrames, embeddings are
DataFrames of array columns.  Every operator declares its plan with the
DataFrame API and leaves the physical strategy to Catalyst.
"""

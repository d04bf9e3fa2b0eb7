"""Spark-native biclustering analytics: matrices, memberships, networks and result queries as DataFrames."""

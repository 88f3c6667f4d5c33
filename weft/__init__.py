"""weft: a Spark-native engine for text corpora, symbol graphs and session logs.

Everything is a function from DataFrames to a DataFrame.  Nothing here needs a
server; the only state on disk are tables in the cluster's shared folder.
"""

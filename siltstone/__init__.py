"""siltstone: a PySpark-native engine for shared-material corpora.

Every operator is a function from DataFrames to a DataFrame.  Sub-packages:
``functions`` (column expressions), ``operators`` (joins, folds, integrity
checks), ``sources`` (readers and writers), ``streaming`` (the inbox),
``plans`` (registered queries with their SQL) and ``llm`` (text operators).
"""

"""loomfold: a PySpark-native engine for document retrieval, structured
course data and training-data preparation.

Every operator is a function from DataFrames to a DataFrame.  The subpackage
``llm`` is optional: nothing outside it imports it.
"""

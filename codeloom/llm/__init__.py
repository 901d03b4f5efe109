"""Training-data operators for very large text corpora.

Every operator is a function from DataFrames to DataFrames; ``queries`` holds
the registered queries and their SQL.  Nothing else in the library imports
this subpackage.
"""

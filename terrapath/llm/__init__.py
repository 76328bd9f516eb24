"""Operators for building language-model training corpora on Spark.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""

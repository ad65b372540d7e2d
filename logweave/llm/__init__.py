"""Operators for preparing large training corpora with Spark.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` binds them to the test tables.
"""

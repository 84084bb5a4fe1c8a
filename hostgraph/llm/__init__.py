"""Operators of a training-data pipeline over web-scale text, vectors and conversations.

Nothing outside this package imports it.  ``LLM`` holds its registered queries
(``opN_<name>`` and ``pipeline``): name -> (Spark builder, DuckDB SQL or None).
Python code that runs in tasks imports this package there: ship it with ``--py-files``.
"""

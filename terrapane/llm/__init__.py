"""Operators of a training-data pipeline.  Nothing outside this folder imports them.

`terrapane.llm.registry` holds the thin queries and their SQL.
"""

"""Operators that prepare text, media and vectors for training language models.

Nothing outside this folder imports it. ``registry`` holds the queries and their SQL.
"""

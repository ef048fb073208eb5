"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general DataFrame interface; ``queries.py`` holds the thin registered
queries over the driver tables.
"""

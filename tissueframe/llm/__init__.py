"""Training-data operators over text corpora: the ten operators of README's table.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""

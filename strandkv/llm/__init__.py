"""Training-data operators: each module holds one operator with its own general interface.

Nothing outside this folder imports it; queries over the standard tables are in ``queries.py``.
"""

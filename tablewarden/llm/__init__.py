"""Training-data operators: each module holds one operator and its registered query.

Nothing outside this subpackage imports it.
"""

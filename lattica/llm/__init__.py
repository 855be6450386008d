"""Training-data operators: ten stand-alone operators and their queries.

Nothing outside this subpackage imports it.
"""

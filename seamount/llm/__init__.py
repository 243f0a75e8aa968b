"""Training-data operators: each module is one operator; :mod:`queries` registers them.

Nothing outside this subpackage imports it.
"""

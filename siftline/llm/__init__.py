"""Training-data operators: thirteen corpus operators that stand on their own.

Nothing outside this subpackage imports it; deleting it leaves the rest of
the library whole.
"""

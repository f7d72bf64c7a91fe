"""Training-data operators: ten document operators, each by its named method.

Nothing outside this subpackage imports it.
"""

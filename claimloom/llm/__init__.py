"""Training-data operators: deduplication, mixing, tokens, classifiers, rules.

Nothing outside this subpackage imports it.
"""

"""Operators for building language-model training data.

Thirteen operators, one module each; ``queries`` registers them.  Nothing else in
the package imports this subpackage.
"""

"""Operators for preparing training data: one module per operator, plus ``queries`` which registers them.

Nothing outside this subpackage imports it, so it can be removed without touching the rest of the library.
"""

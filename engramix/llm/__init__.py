"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it, so it can be removed whole.
"""

"""Operators for preparing large text and vector collections for model training.

Nothing outside this subpackage imports it.
"""

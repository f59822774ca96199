"""Operators for preparing training text, images and vectors at scale.

Nothing outside this folder imports it.
"""

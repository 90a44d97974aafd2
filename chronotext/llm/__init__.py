"""Operators of a training-data pipeline: tokens, scans, near and exact copies, packing.

Nothing else in the library imports this subpackage.
"""

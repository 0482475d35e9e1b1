"""Operators for large training-data pipelines.

Nothing outside this folder imports it, and it imports nothing from the log
engine, so either half can be used without the other.
"""

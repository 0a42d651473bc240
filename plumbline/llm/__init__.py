"""Operators for preparing training text, independent of the calibration engine.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""

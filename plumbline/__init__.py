"""Calibration and auditing of binary-classifier probabilities on Spark."""

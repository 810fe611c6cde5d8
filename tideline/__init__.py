"""Longitudinal cohort analytics as composable PySpark DataFrame operators."""

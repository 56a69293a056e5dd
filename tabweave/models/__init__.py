"""Estimators: ``fit`` on a DataFrame, ``transform`` adds ``predicted``."""

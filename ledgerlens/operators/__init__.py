"""Relational operators of the reconciliation engine (DataFrame -> DataFrame)."""

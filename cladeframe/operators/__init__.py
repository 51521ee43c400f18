"""Operators on DataFrames: assignments, taxonomy, classification, pairing, metrics, reports."""

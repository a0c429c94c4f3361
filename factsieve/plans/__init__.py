"""Whole analyses: input tables in, result table out."""

"""Whole reviews, their reports, and the catalogue of queries."""

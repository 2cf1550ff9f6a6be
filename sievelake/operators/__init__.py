"""Operators over targets, lines, syntax nodes and findings."""

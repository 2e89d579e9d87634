"""Scalar building blocks: patterns, text slicing, dates, path rules."""

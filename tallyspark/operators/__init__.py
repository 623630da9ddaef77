"""Operators over order lines, each from DataFrame to DataFrame."""

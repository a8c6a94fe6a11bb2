"""Analyses composed of several operators."""

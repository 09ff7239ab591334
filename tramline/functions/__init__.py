"""Scalar expressions and parsers."""

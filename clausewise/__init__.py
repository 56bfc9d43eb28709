"""Controlled-language analysis of document collections on Spark."""

__version__ = "0.1.0"

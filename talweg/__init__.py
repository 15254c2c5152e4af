"""Talweg: document, signal and reliability analytics as DataFrame functions on Spark."""

__version__ = "0.1.0"

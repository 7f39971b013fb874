"""Declarative data-conformance rules and dataset operations as Spark plans."""

__version__ = "0.1.0"

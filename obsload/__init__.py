"""Checked loading of tabular field observations, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"

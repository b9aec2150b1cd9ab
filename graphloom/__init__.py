"""Code-graph analytics expressed as Spark DataFrame computations."""

__version__ = "0.1.0"

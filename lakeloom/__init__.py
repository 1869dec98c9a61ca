"""lakeloom: a code-knowledge analytics engine declared in Spark DataFrames."""

__version__ = "0.1.0"

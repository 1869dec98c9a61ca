"""Training-data operators on text, code and vectors.  Nothing outside imports this package."""

"""Evidence analytics on PySpark: text, citation, timeline and operations operators."""

__version__ = "0.1.0"

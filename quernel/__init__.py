"""quernel: a record-store style analytics engine expressed in PySpark."""

__version__ = "0.1.0"

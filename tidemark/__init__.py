"""Signal-burst analytics expressed as PySpark DataFrame plans."""

__version__ = "0.1.0"

"""loomframe: the data side of machine learning as Spark DataFrame operators."""

__version__ = "0.1.0"

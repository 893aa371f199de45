"""steplake: everyday data work on tables and streams, expressed as Spark DataFrames."""

__version__ = "0.1.0"

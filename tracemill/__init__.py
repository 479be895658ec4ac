"""Process mining for agent traces and other event logs on Spark DataFrames."""

__version__ = "0.1.0"

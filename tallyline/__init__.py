"""Asset-inventory analytics, reconciliation and configuration checks on Spark DataFrames."""

__version__ = "0.1.0"

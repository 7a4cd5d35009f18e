"""slotscribe: index on-chain program activity with Spark and query it as DataFrames."""

__version__ = "0.1.0"

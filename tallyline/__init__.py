"""Usage metering on Spark: exact token accounting, pricing and reporting over session logs."""

__version__ = "0.1.0"

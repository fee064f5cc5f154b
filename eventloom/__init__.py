"""eventloom: event-study analytics over panels and dated evidence, on Spark DataFrames."""

__version__ = "0.1.0"

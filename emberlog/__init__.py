"""emberlog: a log store and query engine written as Spark DataFrame programs."""

__version__ = "0.1.0"

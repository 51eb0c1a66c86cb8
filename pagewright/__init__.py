"""Page-oriented document text at scale, on Spark."""

__version__ = "0.1.0"

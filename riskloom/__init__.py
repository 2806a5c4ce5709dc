"""riskloom: credit-risk feature building, profiling, scoring and monitoring on Spark."""

__version__ = "0.1.0"

"""warraq: a Spark-first analytics engine for news and document streams."""

__version__ = "0.1.0"

"""mudlark: a Spark-first analytics engine for messy files."""

__version__ = "0.1.0"

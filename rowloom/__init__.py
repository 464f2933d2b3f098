"""rowloom: record cleaning, matching, extraction and quality operators as Spark DataFrame transforms."""

__version__ = "0.1.0"

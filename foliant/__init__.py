"""foliant: Spark-first document analytics.

The package is split by concern: ``functions`` (column expressions), ``operators``
(DataFrame to DataFrame), ``sources`` (readers), ``plans`` (named queries with their
SQL twins), ``streaming`` (Structured Streaming variants). ``foliant.llm`` holds the
training-data operators and is imported by nothing else in the library.
"""

__version__ = "0.1.0"

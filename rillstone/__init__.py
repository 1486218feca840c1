"""Batch and streaming analytics operators for PySpark.

Every operator takes and returns DataFrames.  Plans stay declarative so that Catalyst and AQE choose the
physical strategy; the library only adds plan *shapes* that Spark does not pick by itself, such as splitting a
heavy key over many tasks while keeping the exact result.
"""

__version__ = "0.1.0"

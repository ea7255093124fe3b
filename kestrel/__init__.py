"""kestrel: vector, keyword and hybrid retrieval as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames. Nothing holds
state between calls; indexes are tables (Parquet) that Spark reads back.
"""

from kestrel.session import get_spark, shared_path  # noqa: F401

__all__ = ["get_spark", "shared_path"]

"""wayfarer: a Spark-native library that turns noisy place descriptions into a
scored, queryable catalogue and plans multi-day trips from it.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function built
from Spark SQL / DataFrame / ML / Structured Streaming primitives.
"""

from wayfarer.schemas import CATEGORIES, PLACEHOLDER_PHRASES  # noqa: F401
from wayfarer.session import get_spark, shared_path  # noqa: F401

__all__ = ["CATEGORIES", "PLACEHOLDER_PHRASES", "get_spark", "shared_path"]

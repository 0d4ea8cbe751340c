"""beamspark: array stacking, resampling and audit analytics as PySpark DataFrame jobs."""

from beamspark.session import get_spark

__all__ = ["get_spark"]

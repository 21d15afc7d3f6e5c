"""Session settings the wide plans of this package want."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM does not compile methods above 8000 bytes. Spark then splits the code
# of a wide projection instead of running one interpreted method.
_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; everything else is left to the cluster."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark

"""Session settings that the library's plans are read under best; none changes a result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

HUGE = "spark.sql.codegen.hugeMethodLimit"
SETTINGS = {
    # the JVM doesn't compile methods of over 8,000 bytes: rules in one generated method then run interpreted, several times slower
    HUGE: "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def compiled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with a limit of methods' size under which rules run compiled, whatever the session was started with."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set(HUGE, SETTINGS[HUGE])
        return query(spark, sf_dir)

    return run


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)

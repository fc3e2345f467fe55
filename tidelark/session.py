"""Settings that long expressions (option pricing, curve folds) run well under."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The JVM compiles no method over 8,000 bytes. A stage whose generated method is longer is better run operator by operator, each of whose expressions is split into short methods.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.session.timeZone": "UTC"}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder

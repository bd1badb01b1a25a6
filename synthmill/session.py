"""Session options the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot does not compile methods beyond 8000 bytes of bytecode.  Spark's own limit for a fused
# stage is far above that, so a wide generated record would run interpreted, several times slower;
# with this limit Spark splits the projection into small methods instead.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
HUGE_METHOD_DEFAULT, HUGE_METHOD_COMPILED = "65535", "8000"


# Rows of an Arrow batch.  Spark's own number suits narrow rows: of whole texts, so many are tens of MB that the executor
# holds beside its heap and the Python worker once more.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS_DEFAULT, BATCH_ROWS_OF_TEXTS = "10000", "1024"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows; a number the user has chosen is left alone."""
    if spark.conf.get(BATCH_ROWS, BATCH_ROWS_DEFAULT) == BATCH_ROWS_DEFAULT:
        spark.conf.set(BATCH_ROWS, BATCH_ROWS_OF_TEXTS)


def tune(spark: SparkSession) -> None:
    """Let generated records be compiled; a limit the user has chosen is left alone."""
    if spark.conf.get(HUGE_METHOD, HUGE_METHOD_DEFAULT) == HUGE_METHOD_DEFAULT:
        spark.conf.set(HUGE_METHOD, HUGE_METHOD_COMPILED)

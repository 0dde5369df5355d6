"""Parallelism helper for CPU-heavy row work after a narrow scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting: the number of partitions to deal rows over before CPU-heavy
#: work.  Unset (the default): rows stay in the splits of the scan, which at
#: scale are many; set it where a table is one small file.
SPREAD = "spark.tidepool.spread"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over as many partitions as the session asks
    for, or as it is."""
    n = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(n), key) if n else df

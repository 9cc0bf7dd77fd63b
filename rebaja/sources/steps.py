"""Steps of past runs as tables by brand and week, of which readers open only the weeks they want."""
from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rebaja.sources.tables import write_step

KEYS = ("brand", "week")


class StepStore:
    """Tables under one root in a folder per brand and week. A run replaces the weeks it writes and leaves all others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the (brand, week) partitions that ``df`` holds."""
        write_step(df, self.path(name), KEYS)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path(name)).withColumn("week", F.col("week").cast("date"))

    def weeks(self, name: str) -> DataFrame:
        """(brand, week) of all partitions; no column of the files is read."""
        return self.read(name).select(*KEYS).distinct()

    def latest(self, name: str, count: int = 1, before: datetime.date | None = None) -> DataFrame:
        """Rows of each brand's newest ``count`` weeks (earlier than ``before``).

        The weeks, a few dates per brand, become a literal filter on the
        partition columns, so files of other weeks are not listed as input.
        """
        known = self.weeks(name) if before is None else self.weeks(name).where(F.col("week") < F.lit(before))
        rows = known.groupBy("brand").agg(F.slice(F.sort_array(F.collect_set("week"), False), 1, count).alias("weeks")).collect()
        wanted = [(F.col("brand") == r.brand) & F.col("week").isin(r.weeks) for r in rows]
        return self.read(name).where(reduce(lambda a, b: a | b, wanted, F.lit(False)))

"""Entity tables of a weekly run kept as folders, one per entity, by brand where it has one."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rebaja import schemas
from rebaja.sources.tables import ENTITIES, read_raw, write_step


class EntityFolders:
    """The tables a ``WeeklyRun`` asks for, read from ``root`` with their declared schema; ``brands`` prunes folders."""

    def __init__(self, spark: SparkSession, root: str, brands: Sequence[str] | None = None):
        self.spark, self.root, self.brands = spark, root, brands

    def __getattr__(self, entity: str) -> DataFrame:
        if entity not in ENTITIES:
            raise AttributeError(f"no entity {entity}")
        return read_raw(self.spark, self.root, entity, self.brands)


def write_entities(tables, root: str, entities: Sequence[str] = tuple(ENTITIES)) -> None:
    """Write entity tables (attributes of ``tables``) as folders; a brand present in the data replaces its folder only."""
    for entity in entities:
        df, path = schemas.complete(getattr(tables, entity), ENTITIES[entity]), f"{root.rstrip('/')}/{entity}"
        if "brand" in df.columns:
            write_step(df, path, ["brand"])
        else:
            df.write.mode("overwrite").parquet(path)

"""Readers and writers of entity tables, action files, decisions and databases."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rebaja import schemas

ENTITIES = {
    "transactions": schemas.TRANSACTIONS, "products": schemas.PRODUCTS, "stores": schemas.STORES, "stock": schemas.STOCK,
    "costs": schemas.COSTS, "official_prices": schemas.OFFICIAL_PRICES, "reference_prices": schemas.REFERENCE_PRICES,
    "rebates": schemas.REBATES, "traffic": schemas.TRAFFIC, "weather": schemas.WEATHER,
    "competitor_prices": schemas.COMPETITOR_PRICES, "backorder": schemas.BACKORDER,
    "replenishment": schemas.REPLENISHMENT, "markdown_contribution": schemas.MARKDOWN_CONTRIBUTION,
}


def read_raw(spark: SparkSession, root: str, entity: str, brands: Sequence[str] | None = None) -> DataFrame:
    """An entity table with its declared schema; ``brands`` prunes partitions.

    Columns the files lack come back as typed NULLs.
    """
    df = spark.read.schema(ENTITIES[entity]).parquet(f"{root.rstrip('/')}/{entity}")
    if brands is not None and "brand" in df.columns:
        df = df.where(F.col("brand").isin(list(brands)))
    return df


def read_raw_all(spark: SparkSession, root: str, brands: Sequence[str] | None = None,
                 entities: Sequence[str] = ("transactions", "products", "stores", "traffic", "stock")) -> dict[str, DataFrame]:
    return {e: read_raw(spark, root, e, brands) for e in entities}


def write_step(df: DataFrame, path: str, partitions: Sequence[str] = ("brand", "week"), fmt: str = "parquet") -> None:
    """Write a step's table; only the partitions present in ``df`` are replaced.

    Rows are first gathered by partition value and a few hash slices, so a
    partition gets a bounded number of files and a hot one is not written by a
    single task.
    """
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in partitions][:3]), F.lit(8))
    df.repartition(*[F.col(p) for p in partitions], spread).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, partitions: Sequence[str] = ("brand", "week")) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*partitions).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_actions_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.ACTIONS_CSV) -> DataFrame:
    """Weekly action files; the week comes from the file name ``pricing_actions_<date>.csv``.

    The schema is declared, so numeric store codes stay text. Columns are read
    in the declared order unless a header names them.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"pricing_actions_(?:channel_)?(\d{4}-\d{2}-\d{2})", 1)
    return df.withColumn("week", F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd"))


def read_decisions_json(spark: SparkSession, path: str) -> DataFrame:
    """Decision documents ``{week, brand, decisions: {key: record}}`` as one row per key."""
    docs = spark.read.schema(schemas.DECISIONS_JSON).option("multiLine", True).json(path)
    return (
        docs.select("brand", F.try_to_date("week").alias("week"), F.explode("decisions").alias("key", "r"))
        .where("r is not null and r.status <> ''")
        .select("brand", "week", "key", "r.status", "r.manual_price", F.try_to_timestamp("r.timestamp").alias("ts"),
                F.col("r.user").alias("event_user"), "r.chain_scope", "r.chain_key",
                F.col("r.estimated_impact.margin_pct").alias("manual_margin_pct"),
                F.col("r.estimated_impact.velocity").alias("manual_velocity"))
    )


def read_jdbc_table(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None,
                    partition: tuple[str, int, int, int] | None = None, fetch: int = 10_000) -> DataFrame:
    """Rows of a database query, read by several tasks when ``partition`` is given.

    ``partition``: column, lower bound, upper bound, tasks. Filters and columns
    that Spark can push are sent to the database.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, tasks = partition
    return (reader.option("dbtable", f"({query}) AS src").option("partitionColumn", column).option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", tasks).load())

"""The log table in an Iceberg catalog, or as Parquet files where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.config import AppenderConfig
from logloom.functions.scalars import table_name
from logloom.schema import LOGS

CATALOG, NAMESPACE = "iceberg_catalog", "default"


def session_options(config: AppenderConfig) -> dict[str, str]:
    """Settings of the session for a REST catalog on S3-like storage."""
    prefix = f"spark.sql.catalog.{CATALOG}"
    return {
        "spark.jars.packages": "org.apache.iceberg:iceberg-spark-runtime-4.0_2.13:1.10.0,org.apache.iceberg:iceberg-aws-bundle:1.10.0",
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": "rest",
        f"{prefix}.uri": config.catalog_uri,
        f"{prefix}.io-impl": "org.apache.iceberg.aws.s3.S3FileIO",
        f"{prefix}.warehouse": f"s3://{config.s3_bucket}/",
        f"{prefix}.s3.endpoint": config.s3_endpoint,
        f"{prefix}.s3.access-key-id": config.s3_access_key,
        f"{prefix}.s3.secret-access-key": config.s3_secret_key,
        f"{prefix}.s3.path-style-access": "true",
        f"{prefix}.client.region": "us-east-1",
    }


def ddl(name: str, provider: str = "iceberg", catalog: str = CATALOG) -> list[str]:
    """Statements that create the namespace and the table if they aren't there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LOGS.fields)
    full = table_name(name, catalog, NAMESPACE)
    return [f"CREATE NAMESPACE IF NOT EXISTS {catalog}.{NAMESPACE}", f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING {provider}"]


def create(spark: SparkSession, name: str, provider: str = "iceberg", catalog: str = CATALOG) -> str:
    for statement in ddl(name, provider, catalog):
        spark.sql(statement)
    return table_name(name, catalog, NAMESPACE)


def logs_of(spark: SparkSession, folder: str) -> DataFrame:
    """The log table of a folder that the stream writes: its columns, without the batches' numbers."""
    return spark.read.schema(LOGS).option("recursiveFileLookup", "true").parquet(folder)


def register(spark: SparkSession, folder: str, name: str = "logs") -> None:
    """Makes the table known to SQL."""
    logs_of(spark, folder).createOrReplaceTempView(name)


def compact(spark: SparkSession, folder: str, out: str, mb_per_file: int = 256, row_bytes: int = 200) -> None:
    """Rewrites small files into larger ones, rows of a service near one another so that file statistics skip."""
    rows = logs_of(spark, folder)
    files = max(1, rows.count() * row_bytes // (mb_per_file << 20))
    rows.repartitionByRange(files, "service_name", "timestamp").sortWithinPartitions("service_name", F.col("timestamp")).write.parquet(out)

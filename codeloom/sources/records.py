"""Record sources and sinks: external evidence as JSON, expectations as TSV, snapshots as Parquet."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the tables of a store; a store of another version is written anew.
SCHEMA_VERSION = "2"

CANDIDATE = "struct<file:string,symbol:string,start_line:bigint,end_line:bigint,score:double>"
COMPACT, FULL = 8, 16


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(provider, candidates) of JSON documents, one or many to a file; malformed ones keep their text."""
    return spark.read.schema(f"provider string, candidates array<{CANDIDATE}>, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE")


def evidence_from(texts: DataFrame, column: str = "json") -> DataFrame:
    """The same from a string column."""
    return texts.withColumn("_e", F.from_json(column, f"provider string, candidates array<{CANDIDATE}>")).select(
        *[c for c in texts.columns if c != column], F.col("_e.provider").alias("provider"), F.col("_e.candidates").alias("candidates")
    )


def cut_candidates(evidence: DataFrame, most: int = FULL) -> DataFrame:
    """At most ``most`` candidates of a document, with how many there were and how many were left out."""
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return evidence.withColumn("total", n).withColumn("omitted", F.greatest(n - most, F.lit(0))).withColumn("candidates", F.slice("candidates", 1, most))


EXPECTATION = "task string, first_file string, seed_file string, seed_symbol string, strategy string, seed string"


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated expectations; lines that start with # and blank ones are skipped, missing columns are null."""
    return spark.read.schema(EXPECTATION).csv(path, sep="\t", comment="#", quote="", mode="PERMISSIVE").filter("task is not null and trim(task) <> ''")


def write_snapshot(df: DataFrame, folder: str, name: str, version: int) -> str:
    """Write a new snapshot of a table beside the older ones; readers switch by its path."""
    path = f"{folder.rstrip('/')}/{name}/v{version}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_manifest(spark: SparkSession, folder: str, values: dict[str, str]) -> None:
    """Write (key, value) rows of a store: its schema version, the paths of its snapshots and what else is kept."""
    rows = sorted((values | {"schema_version": SCHEMA_VERSION}).items())
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict[str, str] | None:
    """Keys and values of a store; None if it has none or is of another version."""
    try:
        found = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").parquet(f"{folder.rstrip('/')}/manifest").collect()}
    except AnalysisException:
        return None
    return found if found.get("schema_version") == SCHEMA_VERSION else None


def read_json_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expectations as a JSON array of objects of the same names."""
    return spark.read.schema(EXPECTATION).json(path, multiLine=True).filter("task is not null and trim(task) <> ''")

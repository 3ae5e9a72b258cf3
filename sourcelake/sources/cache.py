"""The summary cache: a ``(key, summary)`` table in versioned folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelake import schemas
from sourcelake.operators.summaries import cache_misses
from sourcelake.session import fresh_path, materialize


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.SUMMARY_CACHE)


def missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there; all other failures are real."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; a missing one is empty."""
    try:
        return spark.read.schema(schemas.SUMMARY_CACHE).parquet(path)
    except AnalysisException as e:
        if not missing(e):
            raise
        return empty_cache(spark)


def import_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries of files holding one JSON object each.

    A missing file, broken JSON or another JSON value gives no entries, and
    entries that are not strings are left out."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not missing(e):
            raise
        return empty_cache(spark)
    parsed = F.from_json("value", "map<string,variant>")
    entries = text.where(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("{")).select(
        F.explode(parsed).alias("key", "entry")
    )
    return entries.where(F.schema_of_variant("entry") == "STRING").select(
        "key", F.try_variant_get("entry", "$", "string").alias("summary")
    )


def write_cache(cache: DataFrame, path: str | None = None) -> str:
    """Write a first version of the cache and return its location."""
    path = path or fresh_path(cache.sparkSession, "summary-cache")
    cache.write.mode("errorifexists").parquet(path)
    return path


def append_cache(spark: SparkSession, path: str, structures: DataFrame) -> None:
    """Add the summaries that the cache at ``path`` lacks.

    What is there is read for its keys and left as it is; the misses come as
    new files, written elsewhere first so that none is read while it is written."""
    misses = materialize(cache_misses(read_cache(spark, path), structures), "cache-misses")
    misses.write.mode("append").parquet(path)

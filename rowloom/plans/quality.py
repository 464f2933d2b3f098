"""Queries of the column-quality operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import quality
from rowloom.runtime import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles contradicted by their rows, and columns of loads that departed from the dataset's other loads."""
    return quality.profile_findings(table(spark, sf_dir, "people_export"), table(spark, sf_dir, "column_profile"))


def p7_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well every column of every load, and all of them together, tell the load from its sister loads."""
    people = table(spark, sf_dir, "people_export")
    values = quality.column_values(people)
    found = quality.load_discrimination(people, values, quality.base_profile(values))
    return found.select("load_id", "column_name", "n", F.round("auc", 4).alias("auc"), F.round("joint_auc", 4).alias("joint_auc"), F.round("loss", 4).alias("loss"))


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact row, null and distinct counts of every column of every load."""
    values = quality.column_values(table(spark, sf_dir, "people_export"))
    return quality.base_profile(values).select("load_id", "column_name", "row_count", "null_count", "distinct_count")


def p7_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles contradicted by their rows."""
    values = quality.column_values(table(spark, sf_dir, "people_export"))
    return quality.profile_mismatches(table(spark, sf_dir, "column_profile"), values, quality.base_profile(values))


_LONG = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM people_export" for c in quality.PROFILED)
_BASE = f"SELECT load_id, column_name, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE value IS NULL OR value = '') AS null_count, COUNT(DISTINCT value) FILTER (WHERE value <> '') AS distinct_count FROM ({_LONG}) AS v GROUP BY load_id, column_name"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_found, p7_profile, p7_mismatch, p7_discrimination)}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_profile": _BASE,
        "p7_mismatch": f"""
            WITH v AS ({_LONG}), b AS ({_BASE})
            SELECT DISTINCT p.load_id, p.column_name FROM column_profile AS p JOIN b USING (load_id, column_name)
            WHERE p.null_count <> b.null_count OR p.distinct_count <> b.distinct_count
               OR EXISTS (SELECT 1 FROM (SELECT UNNEST(p.sample_values) AS s) AS x WHERE s IS NOT NULL
                          AND NOT EXISTS (SELECT 1 FROM v WHERE v.load_id = p.load_id AND v.column_name = p.column_name AND v.value = s AND v.value <> ''))""",
    }

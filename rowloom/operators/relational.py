"""Relational operators of the record model: duplicates, blocks, candidate pairs, diffs, coverage and review queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import text as t
from rowloom.runtime import Scratch


def exact_duplicates(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``copy`` numbered from 0 within equal tidied, case-folded values; the first in ``order`` is kept as 0.

    Rows are cut into ranges of value and order, so that values that a third of all rows share are numbered by many
    tasks: within a range first, then moved by the counts of the ranges before.
    """
    key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.lower(t.tidy(F.col(c).cast("string"))), F.lit("")) for c in columns]), 256)
    scratch = Scratch(rows.sparkSession)
    cut = scratch.cut(rows.withColumn("_key", key).repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)) - 1
    counts = cut.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    # only values that lie in several ranges have anything before them
    spread = counts.join(counts.groupBy("_key").agg(F.count("*").alias("_k")).where("_k > 1").select("_key"), "_key", "left_semi")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = spread.select("_key", "_part", before.alias("_before"))
    numbered = cut.withColumn("copy", inside).join(moved, ["_key", "_part"], "left")
    return numbered.withColumn("copy", (F.col("copy") + F.coalesce("_before", F.lit(0))).cast("int")).select(*rows.columns, "copy")


def medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., median, n): exact medians of a column of numbers, nulls aside; without groups one row, of n 0 if there are no numbers.

    Values are counted first and cut into ranges; a median is read off the range that holds the middle of its group, so
    neither all values of a group nor the counts of all groups meet in one task.
    """
    keys = list(by)
    scratch = Scratch(rows.sparkSession)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cut = scratch.cut(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select(*keys, "_part", F.col("_n").alias("_size"), before.alias("_before"), F.sum("_n").over(group).alias("_all"))  # one row a group and range
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = placed.where((F.col("_before") <= hi) & (F.col("_before") + F.col("_size") > lo))
    inside = cut.join(holds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_all"), (cut["_part"] == F.col("_p")) & _all_equal(cut, keys))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    at = inside.withColumn("_upto", F.col("_before") + upto)
    middle = at.where((F.col("_upto") > lo) & (F.col("_upto") - F.col("_n") <= hi))
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"), F.coalesce(F.max("_all"), F.lit(0)).alias("n"))


def _all_equal(df: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & df[k].eqNullSafe(F.col(f"_k{i}"))
    return out


def variant_groups(rows: DataFrame, column: str, key: Column) -> DataFrame:
    """(key, preferred, variants, rows): spellings that collide under ``key``; the preferred one is the most frequent, then mixed case, then the shorter, then the first."""
    counted = rows.where(~t.is_empty(F.col(column))).groupBy(key.alias("key"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    best = F.max_by("value", F.struct("n", mixed.alias("m"), (-F.length("value")).alias("l"), F.hex(F.encode("value", "utf-8")).alias("v")))
    return counted.where("key <> ''").groupBy("key").agg(best.alias("preferred"), F.count("*").alias("variants"), F.sum("n").alias("rows")).where("variants > 1")


def block_keys(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """(row_id, block): one row per blocking key of a row; keys maps a kind to its Column, null or empty values give no key."""
    all_keys = F.array_compact(F.array(*[F.when(~t.is_empty(k), F.concat(F.lit(f"{kind}:"), k)) for kind, k in keys.items()]))
    return rows.select(F.col(row_id).alias("row_id"), F.explode(F.array_distinct(all_keys)).alias("block"))


def candidate_pairs(blocks: DataFrame, max_block_size: int = 200) -> DataFrame:
    """(left, right, blocks): pairs that share a block of at most ``max_block_size`` rows, each once with its number of blocks.

    The limit is a feature of the operator: larger blocks are listed by :func:`oversized_blocks` and paired by no one.
    """
    size = blocks.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size").between(2, max_block_size)).select("block")
    kept = blocks.join(size, "block", "left_semi")
    left, right = kept.select("block", F.col("row_id").alias("left")), kept.select("block", F.col("row_id").alias("right"))
    return left.join(right, "block").where("left < right").groupBy("left", "right").agg(F.count("*").alias("blocks"))


def oversized_blocks(blocks: DataFrame, max_block_size: int = 200) -> DataFrame:
    """(block, size) of the blocks that :func:`candidate_pairs` leaves out."""
    return blocks.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > max_block_size)


def record_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change, changed): added, removed, changed or unchanged records by key, with the names of the changed columns in order.

    Each side must have one row per key; keys that are null take no part; null and null are equal.
    """
    cols = list(columns)
    b = before.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*cols).alias("b"))
    a = after.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*cols).alias("a"))
    both = b.join(a, "key", "full")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in cols]))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(moved) > 0, "changed").otherwise("unchanged")
    return both.select("key", change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(moved, ",")).otherwise("").alias("changed"))


def coverage(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, coverage): share of rows with a value, rounded to 3 digits."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), t.is_empty(F.col(c).cast("string")).alias("gone")) for c in columns])).alias("e")
    return rows.select(*by, cells).groupBy(*by, F.col("e.column_name").alias("column_name")).agg(F.round(F.avg(F.when(F.col("e.gone"), 0.0).otherwise(1.0)), 3).alias("coverage"))


def coverage_drift(baseline: DataFrame, current: DataFrame, by: Sequence[str], tolerance: float = 0.2) -> DataFrame:
    """Columns whose coverage fell by more than ``tolerance`` from the baseline."""
    on = [*by, "column_name"]
    both = baseline.withColumnRenamed("coverage", "was").join(current.withColumnRenamed("coverage", "now"), on)
    return both.where(F.col("was") - F.col("now") > tolerance)


def pending_reviews(decisions: DataFrame, settled: DataFrame) -> DataFrame:
    """Possible matches on whose ordered pair no settled decision exists."""
    done = settled.select(F.least("left_row_id", "right_row_id").alias("lo"), F.greatest("left_row_id", "right_row_id").alias("hi")).distinct()
    open_pairs = decisions.where("decision = 'possible_match'").withColumns({"lo": F.least("left_row_id", "right_row_id"), "hi": F.greatest("left_row_id", "right_row_id")})
    return open_pairs.join(done, ["lo", "hi"], "left_anti")


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; rows with a null or empty key part are all kept. A minimum per key, so a key of very many rows is aggregated where they lie."""
    gone = F.lit(False)
    for k in keys:
        gone = gone | t.is_empty(F.col(k).cast("string"))
    rest = [c for c in rows.columns if c not in keys]
    first = rows.where(~gone).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    taken = first.select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in rows.columns])
    return rows.where(gone).unionByName(taken)

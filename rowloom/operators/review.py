"""Review of decisions as append-only action logs: what is in effect is the log without what was reversed.

Tables: actions (action_id, job_id, decision_id, action merge or keep_separate, batch_id, created_at, reversed_at),
constraints (action_id, left, right, kind, created_at, revoked_at), overrides (override_id, column_name, row_id,
created_at, revoked_at). Functions give the rows to append or the table with rows revoked; writing is the caller's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.likelihood import agrees_throughout


class ReviewConflict(Exception):
    """The item was changed by another decision since it was read."""


LINK = {"merge": "must_link", "keep_separate": "must_not_link"}


def in_effect(log: DataFrame, until: str = "revoked_at") -> DataFrame:
    """Rows of a log that nobody took back."""
    return log.where(F.col(until).isNull())


def pending(decisions: DataFrame, constraints: DataFrame) -> DataFrame:
    """Possible matches on whose ordered pair no constraint is in effect."""
    done = in_effect(constraints).select(F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi")).distinct()
    open_pairs = decisions.where("decision = 'possible_match'").withColumns({"lo": F.least("left", "right"), "hi": F.greatest("left", "right")})
    return open_pairs.join(done, ["lo", "hi"], "left_anti").drop("lo", "hi")


def queue(decisions: DataFrame, by: str = "likelihood", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the review queue: by likelihood and score, or by score, or by the ranking, highest first, then by id."""
    order = {"likelihood": [F.coalesce("likelihood", F.lit(-1.0)).desc(), F.col("score").desc()], "score": [F.col("score").desc()], "ranking": [F.coalesce("ranking", F.lit(-1.0)).desc(), F.col("score").desc()]}[by]
    return decisions.orderBy(*order, "decision_id").offset(offset).limit(limit)


def bands(open_pairs: DataFrame, *, likely: float = 0.99, unlikely: float = 0.01) -> DataFrame:
    """(decision_id, left, right, band): pending pairs that can be decided together: at least 99 % likely with no field that disagrees, or under 1 %."""
    band = F.when((F.col("likelihood") >= likely) & agrees_throughout(F.col("evidence")), "likely").when(F.col("likelihood") < unlikely, "unlikely")
    return open_pairs.select("decision_id", "left", "right", band.alias("band")).where("band IS NOT NULL")


def submit(decision: Mapping, action: str, expected_version: int, action_id: str, at: str, values: Mapping[str, str] | None = None) -> dict[str, list[tuple]]:
    """Rows to append for one reviewer's decision; decision: left, right, decision_id, review_version, strengths.

    A pair with a contradiction cannot be merged; a version that moved on is a conflict; chosen values go with a merge
    and come from one of its two rows.
    """
    if action not in LINK:
        raise ValueError("action must be merge or keep_separate")
    if decision["review_version"] != expected_version:
        raise ReviewConflict("this item was changed by another decision")
    if action == "merge" and "guard" in decision["strengths"]:
        raise ValueError("a contradiction forbids this merge")
    if values and action != "merge":
        raise ValueError("chosen values go with a merge")
    pair = (decision["left"], decision["right"])
    if any(row not in pair for row in (values or {}).values()):
        raise ValueError("chosen values must come from one of the two rows")
    return {
        "actions": [(action_id, decision["decision_id"], action, None, at, None)], "constraints": [(action_id, *pair, LINK[action], at, None)],
        "overrides": [(f"{action_id}:{c}", c, row, at, None) for c, row in (values or {}).items()],
    }


def submit_band(banded: DataFrame, band: str, expected_count: int, batch_id: str, at: Column) -> DataFrame:
    """(action_id, batch_id, decision_id, action, left, right, kind, created_at) for every pair of a band, if it still has the number the reviewer saw."""
    chosen = banded.where(F.col("band") == band)
    if (n := chosen.count()) != expected_count:
        raise ReviewConflict(f"the band holds {n} pairs now")
    action = {"likely": "merge", "unlikely": "keep_separate"}[band]
    return chosen.select(F.concat(F.lit(f"{batch_id}:"), "decision_id").alias("action_id"), F.lit(batch_id).alias("batch_id"), "decision_id", F.lit(action).alias("action"), "left", "right", F.lit(LINK[action]).alias("kind"), at.alias("created_at"))


def undo(log: DataFrame, at: Column, *, action_id: str | None = None, batch_id: str | None = None, until: str = "revoked_at") -> DataFrame:
    """The log with an action or a batch taken back; rows taken back before keep their time."""
    hit = F.col("action_id") == action_id if action_id is not None else F.col("batch_id") == batch_id
    return log.withColumn(until, F.when(hit & F.col(until).isNull(), at).otherwise(F.col(until)))


def split(members: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """(left, right, kind): the chosen rows of one cluster and the others may not be linked; members: (row_id). Both sides must have rows."""
    inside = F.col("row_id").isin(*chosen)
    a, b = members.where(inside).select(F.col("row_id").alias("a")), members.where(~inside).select(F.col("row_id").alias("b"))
    return a.crossJoin(b).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), F.lit("must_not_link").alias("kind"))  # the selection of a person


def set_value(overrides: DataFrame, members: Sequence[str], column: str, row_id: str, override_id: str, at: Column) -> DataFrame:
    """The overrides with one row chosen to supply a column of a cluster; earlier choices among its members are revoked."""
    if row_id not in members:
        raise ReviewConflict("that row is no longer in this cluster")
    held = (F.col("column_name") == column) & F.col("row_id").isin(*members) & F.col("revoked_at").isNull()
    kept = overrides.withColumn("revoked_at", F.when(held, at).otherwise(F.col("revoked_at")))
    one = overrides.sparkSession.range(1).select(F.lit(override_id).alias("override_id"), F.lit(column).alias("column_name"), F.lit(row_id).alias("row_id"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return kept.select(*one.columns).unionByName(one)


def training_set(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, evidence, score, label): reviewed decisions with the latest action in effect, 1 for merge."""
    last = in_effect(actions, "reversed_at").groupBy("decision_id").agg(F.max_by("action", F.struct("created_at", "action_id")).alias("action"))
    return decisions.join(last, "decision_id").select("decision_id", "evidence", "score", (F.col("action") == "merge").cast("int").alias("label"))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key (mapping versions, models, preset versions)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def history(log: DataFrame, job_id: str) -> DataFrame:
    """Actions of a job, the newest first."""
    return log.where(F.col("job_id") == job_id).orderBy(F.desc("created_at"), "action_id")

"""Differences of snapshots and runs: keyed diffs with their fields, captures over time, watches and crawl frontiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import text as t
from rowloom.runtime import Scratch

# Columns that tell where a record came from and never count as its content.
PROVENANCE = ("source_url", "source_retrieved_at", "preset_id", "preset_version", "strategy_used", "extraction_mode")


def record_key(columns: Sequence[str]) -> Column:
    """Key of a record as JSON; null if any part is empty."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | t.is_empty(F.col(f"`{c}`").cast("string"))
    return F.when(~F.coalesce(gone, F.lit(True)), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def diff_records(before: DataFrame, after: DataFrame, unique_by: Sequence[str], order: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(key, change, changes): added, removed, changed and unchanged records; changes maps a field to its values before and after.

    The last record of a key by ``order`` counts; provenance, ignored columns and the order itself are no content; a
    column that only one side has is null on the other. Records with an empty key part are only counted, by :func:`diff_counts`.
    """
    skip = {*PROVENANCE, *ignore, order}
    columns = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c not in skip]

    def side(df: DataFrame, name: str) -> DataFrame:
        cols = F.struct(*[(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        return df.select(record_key(unique_by).alias("key"), cols.alias("r"), F.col(order).alias("o")).where("key IS NOT NULL").groupBy("key").agg(F.max_by("r", "o").alias(name))

    both = side(before, "b").join(side(after, "a"), "key", "full")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"b.`{c}`").eqNullSafe(F.col(f"a.`{c}`")), F.struct(F.lit(c).alias("field"), F.struct(F.col(f"b.`{c}`").alias("before"), F.col(f"a.`{c}`").alias("after")).alias("v"))) for c in columns if c not in unique_by]))
    moved = F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), F.map_from_entries(fields))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(moved) > 0, "changed").otherwise("unchanged")
    return both.select("key", change.alias("change"), moved.alias("changes"))


def diff_counts(before: DataFrame, after: DataFrame, unique_by: Sequence[str], order: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(change, n), unkeyed records of the later snapshot included."""
    kept = diff_records(before, after, unique_by, order, ignore).groupBy("change").agg(F.count("*").alias("n"))
    return kept.unionByName(after.where(record_key(unique_by).isNull()).groupBy(F.lit("unkeyed").alias("change")).agg(F.count("*").alias("n")))


def earliest_and_latest(captures: DataFrame, url: str, at: str) -> DataFrame:
    """(url, earliest, latest, captures) of every URL with two captures or more."""
    rest = F.struct(*[c for c in captures.columns if c != url])
    return captures.groupBy(F.col(url).alias("url")).agg(F.min_by(rest, at).alias("earliest"), F.max_by(rest, at).alias("latest"), F.count("*").alias("captures")).where("captures >= 2")


def compare_captures(captures: DataFrame, url: str, at: str, columns: Sequence[str]) -> DataFrame:
    """(url, changed): names of the columns that differ between the earliest and the latest capture of a URL."""
    ends = earliest_and_latest(captures, url, at)
    moved = F.array_compact(F.array(*[F.when(~F.col(f"earliest.{c}").eqNullSafe(F.col(f"latest.{c}")), F.lit(c)) for c in columns]))
    return ends.select("url", F.array_join(moved, ",").alias("changed"))


def due_watches(watches: DataFrame, now: Column) -> DataFrame:
    """Watches that are active, due, and not still running."""
    return watches.where((F.col("status") == "active") & (F.col("next_run_at") <= now) & ~F.coalesce(F.col("running"), F.lit(False)))


def next_run(watches: DataFrame, now: Column, least_minutes: int = 15) -> DataFrame:
    """Watches with the time of their next run: the interval from now, never under the least."""
    step = F.greatest("interval_minutes", F.lit(least_minutes))
    return watches.withColumn("next_run_at", F.timestamp_micros(F.unix_micros(now) + step.cast("long") * 60_000_000))


def consecutive_failures(checks: DataFrame, by: str, at: str, passed: str, last: int = 3) -> DataFrame:
    """(by, failures, status): how many of the last checks failed without a pass after them; disabled where all of them did. Only the last few checks of a key are kept while counting."""
    pick = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(passed).alias("ok"))))), 1, last)
    runs = checks.groupBy(by).agg(pick.alias("r"))
    first_pass = F.array_position(F.transform("r", lambda x: x["ok"]), True)
    failures = F.when(first_pass == 0, F.size("r")).otherwise(first_pass - 1).cast("int")
    return runs.select(by, failures.alias("failures"), F.when(failures >= last, "disabled").otherwise("active").alias("status"))


def unseen(records: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records whose key was not collected before."""
    return records.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def crawl(links: DataFrame, start: Sequence[str], *, most_depth: int, within: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, depth): pages reached from the start by links (source, target), each at its least depth; ``within`` says which may be visited.

    A level is one join of the newly reached pages with the links; visited pages are kept as written tables.
    """
    spark, scratch = links.sparkSession, Scratch(links.sparkSession)
    edges = links.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    if within is not None:
        edges = edges.where(within(F.col("target")))
    edges = scratch.cut(edges)
    reached = scratch.cut(spark.createDataFrame([(u, 0) for u in dict.fromkeys(start)], "url string, depth int"))
    front = reached
    for depth in range(1, most_depth + 1):
        front = scratch.cut(front.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct().join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        grown = scratch.cut(reached.unionByName(front))
        scratch.drop(reached)
        reached = grown
    return reached


def replay_jobs(events: DataFrame, transitions: dict[str, Sequence[str]], job: str = "job_id", order: str = "event_id", state: str = "state") -> DataFrame:
    """(job, state, steps, rejected): the state of every job after its events in order; a step that the table of transitions forbids is rejected.

    A job's events are few by nature; they are folded in order inside one expression.
    """
    allowed = F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    run = events.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(state).alias("s")))), lambda x: x["s"]).alias("e"))
    start = F.struct(F.lit("draft").alias("state"), F.lit(0).alias("steps"), F.lit(0).alias("rejected"))
    step = lambda a, s: F.when(F.array_contains(F.coalesce(F.try_element_at(allowed, a["state"]), F.array().cast("array<string>")), s), F.struct(s.alias("state"), (a["steps"] + 1).alias("steps"), a["rejected"].alias("rejected"))).otherwise(F.struct(a["state"].alias("state"), a["steps"].alias("steps"), (a["rejected"] + 1).alias("rejected")))
    return run.select(job, F.aggregate("e", start, step).alias("f")).select(job, "f.*")

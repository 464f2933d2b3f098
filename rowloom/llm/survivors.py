"""Problem 4: the best row of each duplicate group for every field, by currency reasoning.

Within a group and a field the usable values form a partial order. A row outranks another for certain when its
timestamp is later AND its dataset is more trusted. Where a timestamp is missing, value-transition precedence learned
from all timestamped groups steps in: how often all values of one shape (for instance a formatted phone, a full given
name) were replaced by values of another shape later. A shape that follows another significantly more often than it
precedes it is newer. Precedence is only asked about pairs of rows of which one has no timestamp, and only about rows
that no other outranks for certain, so it never overrules certain order; cycles between shapes are cut. What is left
without a successor is topologically latest.

All of this is decided from extremes and small sets per group that are partially aggregated: the latest time per trust
level (bounded by the number of datasets) and the shapes that occur (a fixed, small set). No two rows of a group are
ever compared with each other, so a giant group is as cheap as many small ones.

A reviewer's override that is in effect beats all reasoning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.parse import STAND_INS
from rowloom.runtime import Scratch, one_per

FIELDS = ("name", "phone", "address", "zip")


def usable(value: Column, field: str) -> Column:
    """Not null, not blank and no stand-in for a missing value."""
    bare = F.lower(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", ""))
    good = (bare != "") & ~bare.isin(*sorted(STAND_INS))
    if field in ("phone", "zip"):
        digits = F.regexp_replace(bare, r"\.0$", "") if field == "zip" else bare
        digits = F.regexp_replace(digits, r"[^0-9]", "")
        good = good & (digits != "") & ~digits.rlike(r"^(\d)\1*$")
        if field == "phone":
            local = F.regexp_replace(digits, "^1(?=[0-9]{10}$)", "")
            good = good & ~local.rlike(r"^(\d)\1*$") & ~local.isin("1234567", "12345678", "123456789", "1234567890", "0123456789")
    return value.isNotNull() & good


def member_ids(column: str | Column) -> Column:
    """Ids of a ';'-separated list as array<bigint>; what is no id is left out."""
    parts = F.split(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), ";")
    return F.array_distinct(F.array_compact(F.transform(parts, lambda x: F.regexp_replace(x, r"[\s ]", "").try_cast("bigint"))))


def groups_of(rows: DataFrame) -> DataFrame:
    """(group_id, row_id) of every list of two or more rows; each member once."""
    lists = rows.select(member_ids("source_row_ids").alias("ids")).where(F.size("ids") >= 2)
    return lists.select(F.array_min("ids").alias("group_id"), F.explode("ids").alias("row_id")).distinct()


def _shape(value: Column, field: str) -> Column:
    """A coarse form of a value, one of at most 100 for a field; precedence is learned between forms."""
    bare = F.trim(value)
    case = F.when(F.upper(bare) == bare, "U").when(F.lower(bare) == bare, "L").otherwise("M")
    if field == "phone":
        return F.when(bare.startswith("+"), "plus").when(bare.startswith("("), "bracket").when(bare.contains("."), "dots").when(bare.rlike("[A-Za-z]"), "noted").when(bare.rlike("^[0-9]+$"), "bare").otherwise("other")
    if field == "zip":
        return F.when(bare.contains("-"), "plus4").when(bare.endswith(".0"), "float").when(F.length(bare) < 5, "short").otherwise("five")
    words = F.least(F.size(F.split(bare, r"\s+")), F.lit(6)).cast("string")
    initial = F.when(bare.rlike(r"(^|\s)[A-Za-z]\.?(\s|$)"), "i").otherwise("f")
    return F.concat(case, words, initial, F.when(bare.contains(","), "c").otherwise(""))


def acyclic(edges: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The (field, older, newer) edges that lie on no cycle: those whose newer end does not lead back to the older one."""
    after: dict[tuple[str, str], set[str]] = {}
    for field, older, newer in edges:
        after.setdefault((field, older), set()).add(newer)

    def leads(field: str, start: str, goal: str) -> bool:
        seen, todo = {start}, [start]
        while todo:
            for nxt in after.get((field, todo.pop()), ()):
                if nxt == goal:
                    return True
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return False

    return [(f, a, b) for f, a, b in edges if not leads(f, b, a)]


def learn_precedence(values: DataFrame, *, least_z: float = 2.58) -> list[tuple[str, str, str]]:
    """(field, older shape, newer shape) learned from timestamped cells: in significantly more of them all values of the one came before all values of the other than the other way round.

    values: (group_id, column_name, shape, updated_at). Significance is a binomial z of ``least_z``. At most 100 shapes a field: the list is small whatever the input.
    """
    span = values.where("updated_at IS NOT NULL").groupBy("group_id", "column_name", "shape").agg(F.min("updated_at").alias("lo"), F.max("updated_at").alias("hi"))
    cell = span.groupBy("group_id", "column_name").agg(F.collect_list(F.struct("shape", "lo", "hi")).alias("s")).where(F.size("s") > 1)
    p = cell.select("column_name", F.explode("s").alias("p"), "s").select("column_name", "p", F.explode("s").alias("q")).where("p.shape <> q.shape AND p.hi < q.lo")
    moves = p.groupBy("column_name", F.least("p.shape", "q.shape").alias("a"), F.greatest("p.shape", "q.shape").alias("b")).agg(F.count_if(F.col("p.shape") < F.col("q.shape")).alias("up"), F.count("*").alias("n"))
    z = (2 * F.col("up") - F.col("n")) / F.sqrt("n")
    found = moves.where(F.abs(z) >= least_z).select("column_name", F.when(z > 0, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(z > 0, F.col("b")).otherwise(F.col("a")).alias("newer"))
    return acyclic(sorted((r["column_name"], r["older"], r["newer"]) for r in found.collect()))


def survivors(rows: DataFrame, overrides: DataFrame, datasets: DataFrame, *, least_z: float = 2.58) -> DataFrame:
    """(group_id, column_name, row_id, basis) for every group of two or more rows and every field with a usable value or an override.

    rows: people_export; overrides: canonical_overrides; datasets: (dataset_id, trust_rank). Further columns are
    ignored. basis tells what decided: ``override`` (the latest one in effect that names a row of the group, ties by
    override_id), ``dominant`` (one usable row beats every other in timestamp and trust, or is the only one),
    ``currency`` (the only topologically latest row by certain and learned precedence), ``tie`` (several are; the newest,
    most trusted, smallest row_id of them is taken, rows without time last). Null timestamps and unknown datasets never
    outrank; rows repeated under one row_id count once; lists naming missing rows are served by the rows that exist.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    members = groups_of(rows)
    kept = one_per(rows.select("row_id", "dataset_id", "updated_at", *FIELDS), ["row_id"])
    trust = datasets.groupBy("dataset_id").agg(F.min(F.col("trust_rank").cast("int")).alias("trust"))
    fields = F.explode(F.array(*[F.when(usable(F.col(f), f), F.struct(F.lit(f).alias("column_name"), _shape(F.col(f), f).alias("shape"))) for f in FIELDS])).alias("e")
    # values are looked at once a row, before the lists; only shapes travel
    shaped = kept.join(trust, "dataset_id", "left").select("row_id", "updated_at", "trust", fields).where("e IS NOT NULL").select("row_id", "updated_at", "trust", "e.column_name", "e.shape")
    values = scratch.cut(members.join(shaped, "row_id"))
    learned = learn_precedence(values, least_z=least_z)

    # certain order: a row is outranked if a better trust level has a later time; it dominates if it is alone on the best level and later than all others
    level = values.groupBy("group_id", "column_name", "trust").agg(F.count("*").alias("n"), F.count("updated_at").alias("n_at"), F.max("updated_at").alias("last"))
    levels = F.collect_list(F.when(F.col("trust").isNotNull(), F.struct("trust", "last", "n")))
    cells = level.groupBy("group_id", "column_name").agg(levels.alias("levels"), F.sum("n").alias("n"), F.sum("n_at").alias("n_at"), F.coalesce(F.sum(F.when(F.col("trust").isNotNull(), F.col("n"))), F.lit(0)).alias("n_trust"))
    top = F.array_min("levels")
    rest = F.array_except("levels", F.array(top))
    greatest = (F.col("n") == F.col("n_at")) & (F.col("n") == F.col("n_trust")) & (top["n"] == 1) & F.forall(rest, lambda t: t["last"] < top["last"])
    cells = cells.select("*", ((F.col("n") == 1) | F.coalesce(greatest, F.lit(False))).alias("dominated"))
    beaten = F.coalesce(F.exists("levels", lambda t: (t["trust"] < F.col("trust")) & (t["last"] > F.col("updated_at"))), F.lit(False))
    front = scratch.cut(values.join(cells, ["group_id", "column_name"]).where(~beaten).select("group_id", "column_name", "row_id", "updated_at", "trust", "shape", "n", "n_at", "dominated"))

    # learned order among what is left: untimed rows against all, timed rows against untimed ones
    newer: dict[tuple[str, str], list[str]] = {}
    for field, a, b in learned:
        newer.setdefault((field, a), []).append(b)
    table = [(f, a, b) for (f, a), b in sorted(newer.items())]
    after = spark.createDataFrame(table, "column_name string, shape string, newer array<string>")
    open_cells = front.where("n_at < n").groupBy("group_id", "column_name").agg(F.collect_set("shape").alias("shapes"), F.collect_set(F.when(F.col("updated_at").isNull(), F.col("shape"))).alias("untimed"))
    left = front.join(open_cells, ["group_id", "column_name"], "left").join(F.broadcast(after), ["column_name", "shape"], "left")  # at most 100 shapes a field
    rivals = F.when(F.col("updated_at").isNull(), F.col("shapes")).otherwise(F.col("untimed"))
    latest = left.where(~F.coalesce(F.arrays_overlap("newer", rivals), F.lit(False)))

    key = F.struct(F.col("updated_at").isNotNull().alias("timed"), F.col("updated_at").alias("at"), (-F.coalesce("trust", F.lit(1 << 30))).alias("trust"), (-F.col("row_id")).alias("id"))
    chosen = latest.groupBy("group_id", "column_name").agg(F.max_by("row_id", key).alias("reasoned"), F.count("*").alias("left"), F.max("dominated").alias("dominated"))
    basis = F.when(F.col("dominated"), "dominant").when(F.col("left") == 1, "currency").otherwise("tie")
    reasoned = chosen.select("group_id", "column_name", "reasoned", basis.alias("basis"))

    field = F.lower(F.regexp_replace("column_name", r"[\s ]", ""))
    valid = overrides.where("revoked_at IS NULL").select(field.alias("column_name"), F.col("row_id").cast("long").alias("row_id"), "created_at", "override_id").where(F.col("column_name").isin(*FIELDS))
    present = members.join(kept.select("row_id"), "row_id", "left_semi")
    named = valid.join(present, "row_id").groupBy("group_id", "column_name").agg(F.max_by("row_id", F.struct("created_at", "override_id")).alias("named"))
    both = reasoned.join(named, ["group_id", "column_name"], "full")
    return both.select("group_id", "column_name", F.coalesce("named", "reasoned").alias("row_id"), F.when(F.col("named").isNotNull(), "override").otherwise(F.col("basis")).alias("basis"))

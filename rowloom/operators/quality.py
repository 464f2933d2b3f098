"""Problem 7: column-level quality profile of every load, checked against its stored profile and its sister loads.

Base aggregates are exact. Every row of every load takes part in the two-sample test: a column's values are turned
into a code of small yes/no features (missing, letter case, marks, digits, length and number against the quantiles of
the dataset, delay of arrival, repetition by degrees), rows are pre-aggregated to counts per (load, column, code,
fold), and on these sufficient statistics one logistic regression per load and column learns to tell the load's rows
from those of the dataset's other loads. It is cross-fitted: each half of the rows is scored by the model of the other
half, and the area under the ROC curve is taken from the exact counts.

Over the scores of all columns a joint classifier of the load, a linear discriminant, is fitted on all rows and
cross-fitted in the same way; leaving one column out of it tells what the column contributes that no other does
(ablation). A discriminant needs means and covariances of the scores only. Scores being linear in the features, those of
the rest follow from how often any two features occur together in the dataset, which is counted once for all its loads;
so every row takes part and the work grows with the rows, not with rows times loads. A column departed if its own
discrimination is large and beyond its sampling error; where it is not beyond it, the loss without the column decides.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.runtime import Scratch

TEXT_COLUMNS = ("name", "phone", "email", "address", "zip")
PROFILED = (*TEXT_COLUMNS, "match_confidence", "updated_at")
#: number of feature bits in a code
BITS = 40


def _missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def column_values(rows: DataFrame, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """(dataset_id, load_id, column_name, value, n0, n1, lag): how often each value occurs in each column of each load, by half of the rows.

    Values are texts, timestamps as their UTC micros; null stays null. Halves are dealt by a hash of row_id, so they do
    not depend on the partitioning. lag is the number of days by which the value's latest row arrived after it, for
    updated_at where there is a loaded_at.
    """
    text = {c: (F.unix_micros(c) if t == "timestamp" else F.unix_micros(F.col(c).cast("timestamp")) if t == "timestamp_ntz" else F.col(c)).cast("string") for c, t in rows.dtypes if c in columns}
    lag = (F.datediff("loaded_at", "updated_at") if "loaded_at" in rows.columns else F.lit(None)).cast("int")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), text[c].alias("value"), (lag if c == "updated_at" else F.lit(None).cast("int")).alias("lag")) for c in columns])).alias("e")
    long = rows.select("dataset_id", "load_id", F.pmod(F.xxhash64("row_id"), F.lit(2)).alias("fold"), cells)
    return long.groupBy("dataset_id", "load_id", F.col("e.column_name").alias("column_name"), F.col("e.value").alias("value")).agg(
        F.count_if(F.col("fold") == 0).alias("n0"), F.count_if(F.col("fold") == 1).alias("n1"), F.max("e.lag").alias("lag"))


def base_profile(values: DataFrame) -> DataFrame:
    """Exact (dataset_id, load_id, column_name, row_count, null_count, distinct_count, least, greatest) from :func:`column_values`."""
    n = F.col("n0") + F.col("n1")
    gone = _missing(F.col("value"))
    number = F.when(F.col("column_name") == "match_confidence", F.col("value").try_cast("double"))
    return values.groupBy("dataset_id", "load_id", "column_name").agg(
        F.sum(n).alias("row_count"), F.sum(F.when(gone, n).otherwise(0)).alias("null_count"), F.count_if(~gone).alias("distinct_count"),
        F.coalesce(F.min(number).cast("string"), F.min(F.when(~gone, F.col("value")))).alias("least"), F.coalesce(F.max(number).cast("string"), F.max(F.when(~gone, F.col("value")))).alias("greatest"),
    )


def profile_mismatches(stored: DataFrame, values: DataFrame, base: DataFrame) -> DataFrame:
    """(load_id, column_name) of stored profiles that the rows contradict.

    A stored count that is null contradicts nothing; a sample is contradicted if it is no value of the column. Stored
    profiles of loads without rows have nothing to be held against and are left out.
    """
    kept = stored.select("load_id", "column_name", F.col("null_count").alias("s_null"), F.col("distinct_count").alias("s_distinct"), "sample_values").where(F.col("column_name").isin(*PROFILED))
    counts = kept.join(base, ["load_id", "column_name"]).where("s_null <> null_count OR s_distinct <> distinct_count").select("load_id", "column_name")
    samples = kept.select("load_id", "column_name", F.explode("sample_values").alias("value")).where("value IS NOT NULL").distinct()
    real = values.where("value <> ''").select("load_id", "column_name", "value")
    false = samples.join(real, ["load_id", "column_name", "value"], "left_anti").select("load_id", "column_name")
    false = false.join(base.select("load_id", "column_name"), ["load_id", "column_name"], "left_semi")
    return counts.unionByName(false).distinct()


#: shares of the filled cells from which on a value counts as repeated, by degrees
REPEATED = (0.02, 0.1, 0.2)


def _bits(column: str, value: Column, n: Column, filled: Column, lag: Column, steps: Column) -> list[Column]:
    """The yes/no features of one column's values, in a fixed order. steps: quantiles of the column in its dataset, of the number or of the length."""
    repeated = [(n >= 5) & (n >= share * filled) for share in REPEATED]
    if column == "match_confidence":
        number = value.try_cast("double")
        return [*repeated, number > 1, number == 1, number < 0.5, number < 0, *[number > steps[k] for k in range(9)]]
    if column == "updated_at":
        at = F.timestamp_micros(value.cast("long"))
        midnight = F.pmod(value.cast("long"), F.lit(86_400_000_000)) == 0
        return [*repeated, F.year(at) < 1990, F.year(at) > 2100, midnight, *[lag > d for d in (-2, 30, 365, 3650)]]
    size = F.length(value)
    upper, lower = F.upper(value) == value, F.lower(value) == value
    digits = size - F.length(F.translate(value, "0123456789", ""))
    commas = size - F.length(F.translate(value, ",", ""))
    digit = lambda c: c.between("0", "9")
    bits = [
        *repeated, upper & ~lower, lower & ~upper, upper & lower, value.contains("_"), commas == 1, commas >= 2, value.endswith(".0"), value.startswith("+"), value.contains("/"), value.contains(";"),
        size != F.octet_length(value), F.trim(value) != value, digit(F.substring(value, 1, 1)), size <= 3, size > 60,
    ]
    if column in ("phone", "zip"):  # short codes, whose length tells their format; that of names and addresses varies freely
        bits += [value.contains("-"), value.contains("("), value.contains("."), value.contains("#"), digit(F.substring(value, -1, 1))]
        bits += [size.between(4, 5), size.between(6, 8), size.between(9, 11), size.between(12, 16), size > 16, digits.between(1, 4), digits.between(5, 6), digits.between(7, 9), digits >= 10]
    else:
        bits += [size > steps[0], size > steps[4], size > steps[8]]
        bits += [digits >= 5] if column == "address" else [value.contains("@"), digits > 0, digit(F.substring(value, -1, 1))]
    if column == "zip":
        first = F.substring(F.trim(value), 1, 1)
        bits += [first.isin("0", "1", "2"), first.isin("3", "4"), first.isin("5", "6"), first.isin("7", "8")]
    return bits


def _coded(values: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """(dataset_id, load_id, column_name, value, n0, n1, code): values with their feature bits; a missing value has bit 0 alone. One branch a column, so that each reads and evaluates its own."""
    filled = base.select("load_id", "column_name", (F.col("row_count") - F.col("null_count")).alias("filled"))
    tenths = [k / 10 for k in range(1, 10)]
    measure = F.when(F.col("column_name") == "match_confidence", F.col("value").try_cast("double")).otherwise(F.length("value"))
    steps = scratch.cut(values.where(~_missing(F.col("value"))).groupBy("dataset_id", "column_name").agg(F.percentile_approx(measure, tenths, 1000).alias("steps")))
    out = None
    for c in PROFILED:
        v = values.where(F.col("column_name") == c).join(filled.where(F.col("column_name") == c).drop("column_name"), "load_id")
        v = v.join(steps.where(F.col("column_name") == c).drop("column_name"), "dataset_id", "left")
        code = F.lit(0).cast("long")
        for k, bit in enumerate(_bits(c, F.col("value"), F.col("n0") + F.col("n1"), F.col("filled"), F.col("lag"), F.col("steps")), start=1):
            code = code + F.when(bit, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        v = v.select("dataset_id", "load_id", F.lit(c).alias("column_name"), "value", "n0", "n1", F.when(_missing(F.col("value")), F.lit(1).cast("long")).otherwise(code).alias("code"))
        out = v if out is None else out.unionByName(v)
    return out


def _fit(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, ridge: float, rounds: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression on counts (Newton's method); both classes weigh the same."""
    p, n = pos.sum(), neg.sum()
    weights = np.zeros(x.shape[1])
    if not p or not n:
        return weights
    half = min(p, n)
    a, b = pos * (half / p), neg * (half / n)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (a - (a + b) * q) - penalty * weights
        step = np.linalg.solve((x * ((a + b) * q * (1 - q))[:, None]).T @ x + np.diag(penalty), grad)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def _auc(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    if not pos.sum() or not neg.sum():
        return 0.5
    level, at = np.unique(score.round(9), return_inverse=True)
    p, n = np.bincount(at, pos, len(level)), np.bincount(at, neg, len(level))
    return float((p * (np.cumsum(n) - n / 2)).sum() / (p.sum() * n.sum()))


def _row_codes(rows: DataFrame, coded: DataFrame) -> DataFrame:
    """(dataset_id, load_id, fold, codes, n): how many rows of each half of a load have the same codes in all columns."""
    text = {c: (F.unix_micros(c) if t == "timestamp" else F.unix_micros(F.col(c).cast("timestamp")) if t == "timestamp_ntz" else F.col(c)).cast("string") for c, t in rows.dtypes if c in PROFILED}
    # equal rows count together from the first; whatever other columns there are may clash
    cells = F.array(*[F.struct(F.lit(k).alias("k"), text[c].alias("value")) for k, c in enumerate(PROFILED)])
    alike = rows.select("dataset_id", "load_id", F.pmod(F.xxhash64("row_id"), F.lit(2)).cast("int").alias("fold"), cells.alias("cells"))
    long = alike.withColumn("row", F.monotonically_increasing_id()).select("dataset_id", "load_id", "fold", "row", F.inline("cells"))
    place = F.element_at(F.create_map(*[x for k, c in enumerate(PROFILED) for x in (F.lit(c), F.lit(k))]), F.col("column_name"))
    code = coded.select("dataset_id", "load_id", place.alias("k"), "value", "code")
    there = (long["load_id"] == code["load_id"]) & long["dataset_id"].eqNullSafe(code["dataset_id"]) & (long["k"] == code["k"]) & long["value"].eqNullSafe(code["value"])
    met = long.join(code, there).select(long["dataset_id"], long["load_id"], "fold", "row", F.struct(long["k"], "code").alias("e"))
    whole = met.groupBy("dataset_id", "load_id", "fold", "row").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["code"]).alias("codes"))
    return whole.groupBy("dataset_id", "load_id", "fold", "codes").agg(F.count("*").alias("n"))


def _bits_of(codes: np.ndarray) -> np.ndarray:
    """The features of all columns side by side, those of column k at k * (BITS + 1), its constant first."""
    return np.hstack([_features(codes[:, k]) for k in range(codes.shape[1])])


def _moments(row_codes: DataFrame) -> dict[tuple[str | None, int], bytes]:
    """How often any two features occur together in the rows of each half of a dataset: packed tables of a fixed size, of which as many come to the driver as there are datasets and halves."""
    size = len(PROFILED) * (BITS + 1)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str | None, int], np.ndarray] = {}
        for batch in batches:
            for key, g in batch.groupby(["dataset_id", "fold"], dropna=False, sort=False):
                key = (None if pd.isna(key[0]) else key[0], int(key[1]))
                for at in range(0, len(g), 4096):
                    x = _bits_of(np.stack(g["codes"].to_numpy()[at : at + 4096]))
                    seen = np.flatnonzero(x.any(axis=0))
                    x = x[:, seen]
                    sums.setdefault(key, np.zeros((size, size)))[np.ix_(seen, seen)] += (x * g["n"].to_numpy(float)[at : at + 4096, None]).T @ x
        yield pd.DataFrame([(d, k, zlib.compress(m.tobytes(), 1)) for (d, k), m in sums.items()], columns=["dataset_id", "fold", "m"])

    def total(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(size * size)
        for packed in g["m"]:
            m += np.frombuffer(zlib.decompress(packed))
        return pd.DataFrame([(key[0], key[1], zlib.compress(m.tobytes(), 1))], columns=["dataset_id", "fold", "m"])

    schema = "dataset_id string, fold int, m binary"
    sums = row_codes.mapInPandas(part, schema).groupBy("dataset_id", "fold").applyInPandas(total, schema)
    return {(r["dataset_id"], r["fold"]): bytes(r["m"]) for r in sums.collect()}


def _spread(second: np.ndarray, first: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances from sums of products and sums."""
    mean = first / n
    return mean, second / n - np.outer(mean, mean)


def _joint_auc(halves: list[tuple | None], use: list[int], ridge: float) -> float:
    """Area under the curve of a linear discriminant of the load, fitted on each half and judged on the other. halves: means and covariances of the scores of the load and of the rest, and rows of the smaller of them; none where one is missing."""
    parts = []
    for fitted, judged in (halves, halves[::-1]):
        if fitted is None or judged is None:
            return 0.5
        (m1, s1), (m0, s0), rows = fitted
        at = np.ix_(use, use)
        w = np.linalg.solve((s1 + s0)[at] / 2 + np.eye(len(use)) * ridge / rows, (m1 - m0)[use])
        (m1, s1), (m0, s0), _ = judged
        spread = float(np.sqrt(max(w @ (s1 + s0)[at] @ w, 1e-12)))
        parts.append(0.5 * (1 + math.erf(float(w @ (m1 - m0)[use]) / spread / math.sqrt(2))))
    return sum(parts) / 2


def _features(code: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(code), 1)), ((code[:, None] >> np.arange(BITS)) & 1).astype(float)])


def load_discrimination(rows: DataFrame, values: DataFrame, base: DataFrame, *, ridge: float = 1.0) -> DataFrame:
    """(load_id, column_name, n, auc, joint_auc, loss): one row per load and column.

    auc: how well the column alone tells the load's rows from the dataset's other loads; joint_auc: how well all columns
    together do, their scores taken as normal; loss: by how much joint_auc falls without the column. All rows count in
    each of them. Loads that are the only one of their dataset have no rest, auc 0.5 and loss 0.
    """
    scratch = Scratch(values.sparkSession)
    coded = scratch.cut(_coded(values, base, scratch))
    own = scratch.cut(coded.groupBy("dataset_id", "load_id", "column_name", "code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    whole = own.groupBy("dataset_id", "column_name", "code").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    loads = own.select("dataset_id", "load_id", "column_name").distinct()
    cells = loads.join(whole, ["dataset_id", "column_name"]).join(own, ["dataset_id", "load_id", "column_name", "code"], "left").na.fill(0, ["n0", "n1"])
    row_codes = scratch.cut(_row_codes(rows, coded))
    shared = values.sparkSession.sparkContext.broadcast(_moments(row_codes))
    width = BITS + 1

    def fit(key: tuple, group: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out, weights = [], {c: np.zeros((2, width)) for c in PROFILED}
        for column, cell in group.groupby("column_name", sort=False):
            x = _features(cell["code"].to_numpy(np.int64))
            used = x.any(axis=0)
            x = x[:, used]
            p0, p1 = cell["n0"].to_numpy(float), cell["n1"].to_numpy(float)
            q0, q1 = cell["t0"].to_numpy(float) - p0, cell["t1"].to_numpy(float) - p1
            w0, w1 = _fit(x, p0, q0, ridge), _fit(x, p1, q1, ridge)
            out.append([key[0], column, int(p0.sum() + p1.sum()), (_auc(x @ w0, p1, q1) + _auc(x @ w1, p0, q0)) / 2])
            weights[column][:, used] = w1, w0  # each half is scored by the model of the other
        halves = []
        dataset = mine["dataset_id"].iloc[0] if len(mine) else None
        for k in (0, 1):
            to_scores = np.zeros((len(PROFILED) * width, len(PROFILED)))
            for c, column in enumerate(PROFILED):
                to_scores[c * width : (c + 1) * width, c] = weights[column][k]
            here = mine[mine["fold"] == k]
            packed = shared.value.get((dataset, k))
            if not len(here) or packed is None:
                halves.append(None)
                continue
            m = np.frombuffer(zlib.decompress(packed)).reshape(len(to_scores), -1)
            count, score = here["n"].to_numpy(float), _bits_of(np.stack(here["codes"].to_numpy())) @ to_scores
            n1, first, second = count.sum(), count @ score, (score * count[:, None]).T @ score
            # of the rest: all rows of the dataset (the first feature is the constant) less the load's
            n0 = m[0, 0] - n1
            halves.append(None if n0 <= 0 else (_spread(second, first, n1), _spread(to_scores.T @ m @ to_scores - second, m[0] @ to_scores - first, n0), min(n0, n1)))
        every = list(range(len(PROFILED)))
        joint = _joint_auc(halves, every, ridge)
        for row in out:
            row += [joint, joint - _joint_auc(halves, [c for c in every if PROFILED[c] != row[1]], ridge)]
        return pd.DataFrame(out, columns=["load_id", "column_name", "n", "auc", "joint_auc", "loss"])

    counts = cells.select("load_id", "column_name", "code", "n0", "n1", "t0", "t1").groupBy("load_id")
    return counts.cogroup(row_codes.groupBy("load_id")).applyInPandas(fit, "load_id long, column_name string, n long, auc double, joint_auc double, loss double")


def profile_findings(rows: DataFrame, stored: DataFrame, *, least_auc: float = 0.66, noise: float = 0.15, least_loss: float = 0.1) -> DataFrame:
    """(load_id, column_name, finding): ``mismatch`` and ``shift`` findings over all loads.

    rows: people_export; stored: column_profile; further columns are ignored. A shift needs a cross-fitted area under
    the curve of least_auc + noise / sqrt(rows of the load), small loads being judged more carefully; least_auc is enough
    where the joint classifier loses least_loss + noise / sqrt(rows) without the column. Null cells are values of their own,
    repeated stored profiles count once, an empty table gives no finding.
    """
    scratch = Scratch(rows.sparkSession)
    values = scratch.cut(column_values(rows), partition_by=["column_name"])
    base = scratch.cut(base_profile(values))
    wrong = profile_mismatches(stored, values, base).withColumn("finding", F.lit("mismatch"))
    found = load_discrimination(rows, values, base)
    error = noise / F.sqrt("n")
    moved = found.where((F.col("auc") >= least_auc + error) | ((F.col("auc") >= least_auc) & (F.col("loss") >= least_loss + error))).select("load_id", "column_name", F.lit("shift").alias("finding"))
    return wrong.unionByName(moved)

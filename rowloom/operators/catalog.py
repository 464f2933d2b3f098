"""Catalogue operators over datasets, runs and collected rows: versions, pages of rows, merges of collected copies, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import text as t
from rowloom.functions.fixed import PLACE_ROLES
from rowloom.runtime import Scratch
from rowloom.sources.web import sitemap_entries

# Roles whose values are shown masked.
SENSITIVE = ("phone", "email", "address", "mailing_address", *PLACE_ROLES, "postal_code", "latitude", "longitude", "name", "first_name", "last_name")


def sensitive_columns(mapping: Mapping[str, str]) -> list[str]:
    """Columns whose role is personal."""
    return [c for c, role in mapping.items() if role in SENSITIVE]


def project_fields(rows: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The declared fields of collected rows in order, missing ones as nulls, and the bookkeeping columns that are there."""
    return rows.select(*[(F.col(f"`{f}`") if f in rows.columns else F.lit(None).cast("string")).alias(f) for f in fields], *[F.col(f"`{k}`") for k in keep if k in rows.columns and k not in fields])


def check_job(mappings: DataFrame, runs: DataFrame, dataset_ids: Sequence[str], mode: str, config: str) -> None:
    """ValueError if a job may not run: a dataset without a confirmed mapping, different kinds of entities, a full run without a completed preview of the same settings.

    mappings: (dataset_id, version, entity_type, confirmed); runs: (config_hash, mode, state).
    """
    latest = mappings.where(F.col("dataset_id").isin(*dataset_ids) & F.col("confirmed")).groupBy("dataset_id").agg(F.max_by("entity_type", "version").alias("entity_type")).collect()
    if missing := set(dataset_ids) - {r["dataset_id"] for r in latest}:
        raise ValueError(f"no confirmed mapping for {sorted(missing)}")
    if len({r["entity_type"] for r in latest}) > 1:
        raise ValueError("the datasets hold different kinds of entities")
    if mode == "full" and runs.where((F.col("config_hash") == config) & (F.col("mode") == "preview") & (F.col("state") == "completed")).isEmpty():
        raise ValueError("a full run needs a completed preview with the same settings")


def preview(rows: DataFrame, dataset: str, order: str, limit: int) -> DataFrame:
    """The first rows of every dataset by their number; a limit per dataset, not a sample."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(dataset).orderBy(order))).where(F.col("_k") <= limit).drop("_k")


def latest_versions(datasets: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Datasets with the highest version of their mapping, null where there is none."""
    return datasets.join(versions.groupBy(key).agg(F.max("version").alias("version")), key, "left")


def open_flags(flags: DataFrame, dataset_id: str) -> DataFrame:
    """Flags on the mapping of a dataset that nobody resolved, the oldest first."""
    return flags.where((F.col("dataset_id") == dataset_id) & F.col("resolved_at").isNull()).orderBy("created_at", "flag_id")


def project_summary(datasets: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(datasets, rows, runs, matches, clusters): totals over all datasets and the latest full run of each.

    datasets: (dataset_id); rows: (dataset_id, ...); runs: (dataset_id, run_id, completed_at, mode, matches, clusters).
    """
    last = runs.where("mode = 'full' AND completed_at IS NOT NULL").groupBy("dataset_id").agg(F.max_by(F.struct("matches", "clusters"), F.struct("completed_at", "run_id")).alias("r"))
    totals = last.agg(F.count("*").alias("runs"), F.coalesce(F.sum("r.matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum("r.clusters"), F.lit(0)).alias("clusters"))
    return datasets.agg(F.count_distinct("dataset_id").alias("datasets")).crossJoin(rows.agg(F.count("*").alias("rows"))).crossJoin(totals)  # one row each


def type_counts(found: DataFrame) -> DataFrame:
    """(syntax, type, n) of structured entities."""
    return found.groupBy("syntax", "type").agg(F.count("*").alias("n"))


def attach_rows(pairs: DataFrame, rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """Pairs of the review queue with the values of both rows and the names of their datasets. rows: (row_id, dataset_id, raw); datasets: (dataset_id, dataset_name)."""
    named = rows.join(datasets.select("dataset_id", "dataset_name"), "dataset_id", "left")
    side = lambda s: named.select(F.col("row_id").alias(s), F.struct("dataset_name", "raw").alias(f"{s}_row"))
    return pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")


def cluster_page(clusters: DataFrame, canonical: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the clusters of several rows with their survivor, the largest first. clusters: (cluster_id, row_id); canonical: (cluster_id, survivor_row_id, ...)."""
    sized = clusters.groupBy("cluster_id").agg(F.count("*").alias("members")).where("members > 1")
    return sized.join(canonical.select("cluster_id", "survivor_row_id").distinct(), "cluster_id").orderBy(F.desc("members"), "cluster_id").offset(offset).limit(limit)


def merge_copies(rows: DataFrame, key: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns...): one row per key with the first filled value of every column by order; rows without a key are kept as they are under a key of their own."""
    keyed = rows.withColumn("key", F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("row:"), F.col(order).cast("string"))))
    first = [F.min_by(F.col(f"`{c}`"), F.when(~t.is_empty(F.col(f"`{c}`").cast("string")), F.col(order))).alias(c) for c in columns]
    return keyed.groupBy("key").agg(*first)


def first_by_last_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first seen, with ``last_seen`` by which the result is ordered; formula guards are taken off text columns, and rows without a key left out."""
    bare = rows.select(*[F.regexp_replace(c, r"^'(?=[=+@-])", "").alias(c) if k == "string" else F.col(c) for c, k in rows.dtypes])
    rest = [c for c in bare.columns if c != key]
    g = bare.where(~t.is_empty(F.col(key).cast("string"))).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("f"), F.max(order).alias("last_seen"))
    return g.select(key, "f.*", "last_seen")


def with_details(rows: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Rows in which a filled value of the details of the same key replaces their own."""
    shared = [c for c in details.columns if c != key]
    d = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in shared])
    own = [c for c in rows.columns if c not in shared]
    pick = lambda c: F.coalesce(F.when(~t.is_empty(F.col(f"_d_{c}").cast("string")), F.col(f"_d_{c}")), F.col(c) if c in rows.columns else F.lit(None)).alias(c)
    return rows.join(d, key, "left").select(*own, *[pick(c) for c in shared])


def fold_in(rows: DataFrame, others: DataFrame, keys: Sequence[Column], columns: Sequence[str], row_id: str, order: str) -> DataFrame:
    """Rows whose blanks are filled from other records of the same place: by the first of the keys (of either side, in order) that finds any, and of several by order.

    keys are expressions that hold on both tables; an empty key finds nothing.
    """
    place = F.explode(F.filter(F.transform(F.array(*keys), lambda k, i: F.struct(i.alias("rank"), k.alias("key"))), lambda e: F.coalesce(e["key"], F.lit("")) != "")).alias("e")
    blank = lambda c: t.is_empty(F.col(c).cast("string"))
    right = others.select(F.col(order).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in columns], place).select("_o", *[f"_o_{c}" for c in columns], "e.rank", "e.key")
    # what a key supplies is settled once per key, so that a key of many rows costs no more than its rows
    best = right.groupBy("rank", "key").agg(*[F.min(F.when(~blank(f"_o_{c}"), F.struct("_o", f"_o_{c}"))).alias(f"_o_{c}") for c in columns])
    wanting = rows.where(reduce(or_, [blank(c) for c in columns])).select(row_id, place).select(row_id, "e.rank", "e.key")
    met = wanting.join(best, ["rank", "key"])
    first = met.groupBy(row_id).agg(*[F.min(F.when(F.col(f"_o_{c}").isNotNull(), F.struct("rank", f"_o_{c}")))[f"_o_{c}"][f"_o_{c}"].alias(f"_o_{c}") for c in columns])
    filled = lambda c: F.coalesce(F.when(~t.is_empty(F.col(c).cast("string")), F.col(c)), F.col(f"_o_{c}")).alias(c)
    return rows.join(first, row_id, "left").select(*[filled(c) if c in columns else F.col(c) for c in rows.columns])


def months(start: Column, end: Column) -> Column:
    """array<struct<year,month>> from one month to another, both included; empty if the end comes first."""
    run = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(F.when(F.trunc(end, "month") >= F.trunc(start, "month"), run).otherwise(F.array().cast("array<date>")), lambda d: F.struct(F.year(d).alias("year"), F.month(d).alias("month")))


def last_runs(runs: DataFrame, watch: str, at: str, n: int = 10) -> DataFrame:
    """The last runs of every watch, numbered from 1, the newest first."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(watch).orderBy(F.desc(at)))).where(F.col("place") <= n)


def dig(c: Column, *path: str) -> Column:
    """A value of a JSON text by a path whose keys are compared without case; null where there is none."""
    out = c
    for step in path:
        out = _by_lower(F.from_json(out, "map<string,string>"), step.lower())
    return out


def _by_lower(m: Column, step: str) -> Column:
    hits = F.map_values(F.map_filter(m, lambda k, _: F.lower(k) == step))
    return F.try_element_at(hits, F.lit(1))


def search_terms(url: Column) -> Column:
    """struct(keywords, params map<string,string>) of a search address: the words asked for, and the other parameters."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]+=."))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.url_decode(F.substring_index(p, "=", -1)).alias("v")))
    words = F.filter(entries, lambda e: e["k"].isin("k", "q", "query", "keywords", "search", "field-keywords"))
    others = F.filter(entries, lambda e, i: ~e["k"].isin("k", "q", "query", "keywords", "search", "field-keywords") & ~F.exists(F.slice(entries, 1, i), lambda x: x["k"] == e["k"]))
    return F.struct(F.try_element_at(F.transform(words, lambda e: e["v"]), F.lit(1)).alias("keywords"), F.map_from_entries(others).alias("params"))


def expand_sitemaps(maps: DataFrame, start: Sequence[str], *, most_levels: int = 5) -> DataFrame:
    """(loc, lastmod): pages of the sitemaps that the start leads to, each once; maps: (url, content) as landed. A level is one join; maps that were read are not read again."""
    spark, scratch = maps.sparkSession, Scratch(maps.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for u, content in zip(batch["url"], batch["content"], strict=True):
                if content is not None:
                    try:
                        rows += [(u, e["kind"], e["loc"], e["lastmod"]) for e in sitemap_entries(content.encode() if isinstance(content, str) else bytes(content))]
                    except (ValueError, SyntaxError):
                        continue
            yield pd.DataFrame(rows, columns=["url", "kind", "loc", "lastmod"])

    entries = scratch.cut(maps.select("url", "content").mapInPandas(parse, "url string, kind string, loc string, lastmod string"))
    seen = front = scratch.cut(spark.createDataFrame([(u,) for u in dict.fromkeys(start)], "url string"))
    for _ in range(most_levels):
        front = scratch.cut(entries.where("kind = 'map'").join(front, "url", "left_semi").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if front.isEmpty():
            break
        seen = scratch.cut(seen.unionByName(front))
    return entries.where("kind = 'page'").join(seen, "url", "left_semi").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def effective_status(presets: DataFrame, health: DataFrame, key: str = "preset_id") -> DataFrame:
    """Presets with the status they have by their health: disabled by hand or by three failures in a row, degraded by one. health: (key, failures)."""
    h = presets.join(health.select(key, "failures"), key, "left")
    return h.withColumn("effective_status", F.when(F.col("status") == "disabled", "disabled").when(F.col("failures") >= 3, "disabled").when(F.col("failures") >= 1, "degraded").otherwise(F.col("status")))

"""Queries of the catalogue operators over the driver's tables, with SQL of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import catalog as c
from rowloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty rows of every dataset."""
    return c.preview(table(spark, sf, "people_export").select("row_id", "dataset_id", F.struct("load_id", "source_row_number", "row_id").alias("at")), "dataset_id", "at", 20).select("row_id", "dataset_id")


def dataset_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets with their highest load."""
    loads = table(spark, sf, "people_export").select("dataset_id", F.col("load_id").alias("version"))
    return c.latest_versions(table(spark, sf, "datasets").select("dataset_id"), loads, "dataset_id")


def project_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over all datasets and the latest load of each."""
    p = table(spark, sf, "people_export")
    runs = p.groupBy("dataset_id", F.col("load_id").alias("run_id")).agg(F.max("loaded_at").alias("completed_at"), F.count("*").alias("matches"), F.count("email").alias("clusters")).withColumn("mode", F.lit("full"))
    return c.project_summary(table(spark, sf, "datasets"), p, runs)


def queue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Possible matches with the names of both rows and their datasets."""
    d = table(spark, sf, "decisions").distinct().where("decision = 'possible_match'").select("decision_id", F.col("left_row_id").alias("left"), F.col("right_row_id").alias("right"))
    rows = table(spark, sf, "people_export").select("row_id", "dataset_id", F.col("name").alias("raw")).distinct()
    q = c.attach_rows(d, rows, table(spark, sf, "datasets"))
    return q.select("decision_id", F.col("left_row.dataset_name").alias("left_dataset"), F.col("left_row.raw").alias("left_name"), F.col("right_row.dataset_name").alias("right_dataset"), F.col("right_row.raw").alias("right_name"))


def merged_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts with one telephone as one row, the first filled value of each column."""
    crm = table(spark, sf, "crm_contacts").select("crm_id", "full_name", "mobile", "street", "zip_code")
    return c.merge_copies(crm, F.regexp_replace("mobile", "[^0-9]", ""), "crm_id", ["full_name", "street", "zip_code"])


def first_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """The first contact of every postal code with where the code was last seen."""
    return c.first_by_last_seen(table(spark, sf, "crm_contacts").select("zip_code", "crm_id", "full_name"), "zip_code", "crm_id")


def detailed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose status is replaced by that of their details where these have one."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    d = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise("").alias("o_orderstatus"), F.lit("seen").alias("note"))
    return c.with_details(o, d, "o_orderkey")


def folded_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts whose missing town is filled from others of the same street and code, or of the same code."""
    crm = table(spark, sf, "crm_contacts").select("crm_id", "street", "city", "zip_code")
    keys = [F.when((F.col("street") != "") & (F.col("zip_code") != ""), F.concat_ws("|", F.lower("street"), "zip_code")), F.col("zip_code")]
    return c.fold_in(crm, crm, keys, ["city"], "crm_id", "crm_id").select("crm_id", "city")


def order_months(spark: SparkSession, sf: str) -> DataFrame:
    """Months from the first to the last order of every priority."""
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return g.select("o_orderpriority", F.explode(c.months(F.col("a"), F.col("b"))).alias("m")).select("o_orderpriority", "m.year", "m.month")


def last_events(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten events of every user."""
    return c.last_runs(table(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at")), "user_id", "at").select("user_id", "event_id", "place")


def nested_values(spark: SparkSession, sf: str) -> DataFrame:
    """A value of event properties by keys without case."""
    doc = F.concat(F.lit('{"Outer": {"PROPS": '), "props", F.lit("}}"))
    return table(spark, sf, "events").select("event_id", c.dig(doc, "outer", "props", "K").alias("k"), c.dig(doc, "outer", "none").alias("none"))


def searches(spark: SparkSession, sf: str) -> DataFrame:
    """Words and parameters of search addresses made of parts."""
    u = F.concat(F.lit("https://x.example/s?k="), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("&low="), F.col("p_size").cast("string"), F.lit("&empty=&low=9"))
    s = c.search_terms(u)
    return table(spark, sf, "part").select("p_partkey", s["keywords"].alias("keywords"), s["params"]["low"].alias("low"))


def sitemap_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of sitemaps made of regions and nations: an index, a map a region, a page a nation; a map that points back is read once."""
    n = table(spark, sf, "nation")
    pages = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>https://x.example/n/"), F.col("n_nationkey").cast("string"), F.lit("</loc></url>")))), "").alias("b"))
    maps = pages.select(F.concat(F.lit("https://x.example/r"), F.col("n_regionkey").cast("string")).alias("url"), F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("content"))
    index = maps.where("url <> 'https://x.example/r4'").agg(F.concat(F.lit("<sitemapindex><sitemap><loc>https://x.example/index</loc></sitemap>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))), ""), F.lit("</sitemapindex>")).alias("content")).select(F.lit("https://x.example/index").alias("url"), "content")
    return c.expand_sitemaps(maps.unionByName(index), ["https://x.example/index"]).select("loc")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (preview_rows, dataset_versions, project_totals, queue_rows, merged_contacts, first_contacts, detailed_orders, folded_contacts, order_months, last_events, nested_values, searches, sitemap_tree)}


def oracle_sql() -> dict[str, str]:
    return {
        "preview_rows": "SELECT row_id, dataset_id FROM people_export QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY load_id, source_row_number, row_id) <= 20",
        "dataset_versions": "SELECT d.dataset_id, max(load_id) AS version FROM datasets AS d LEFT JOIN people_export AS p USING (dataset_id) GROUP BY d.dataset_id",
        "project_totals": "WITH r AS (SELECT dataset_id, load_id, max(loaded_at) AS done, COUNT(*) AS m, COUNT(email) AS k FROM people_export GROUP BY ALL HAVING max(loaded_at) IS NOT NULL), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY done DESC, load_id DESC) = 1) SELECT (SELECT COUNT(DISTINCT dataset_id) FROM datasets) AS datasets, (SELECT COUNT(*) FROM people_export) AS rows, COUNT(*) AS runs, SUM(m)::BIGINT AS matches, SUM(k)::BIGINT AS clusters FROM l",
        "queue_rows": "WITH d AS (SELECT DISTINCT * FROM decisions WHERE decision = 'possible_match'), p AS (SELECT DISTINCT row_id, dataset_id, name FROM people_export) SELECT decision_id, a.dataset_name AS left_dataset, l.name AS left_name, b.dataset_name AS right_dataset, r.name AS right_name FROM d LEFT JOIN p AS l ON l.row_id = left_row_id LEFT JOIN datasets AS a ON a.dataset_id = l.dataset_id LEFT JOIN p AS r ON r.row_id = right_row_id LEFT JOIN datasets AS b ON b.dataset_id = r.dataset_id",
        "merged_contacts": "SELECT coalesce(nullif(regexp_replace(mobile, '[^0-9]', '', 'g'), ''), 'row:' || crm_id) AS key, first(full_name ORDER BY crm_id) FILTER (WHERE full_name <> '') AS full_name, first(street ORDER BY crm_id) FILTER (WHERE street <> '') AS street, first(zip_code ORDER BY crm_id) FILTER (WHERE zip_code <> '') AS zip_code FROM crm_contacts GROUP BY 1",
        "first_contacts": "SELECT zip_code, min(crm_id) AS crm_id, regexp_replace(first(full_name ORDER BY crm_id), '^''([=+@-])', '\\1') AS full_name, max(crm_id) AS last_seen FROM crm_contacts WHERE zip_code <> '' GROUP BY zip_code",
        "detailed_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' END AS note FROM orders",
        "folded_contacts": "SELECT c.crm_id, CASE WHEN c.city <> '' THEN c.city ELSE coalesce((SELECT first(o.city ORDER BY o.crm_id) FROM crm_contacts AS o WHERE o.city <> '' AND c.street <> '' AND c.zip_code <> '' AND lower(o.street) = lower(c.street) AND o.zip_code = c.zip_code), (SELECT first(o.city ORDER BY o.crm_id) FROM crm_contacts AS o WHERE o.city <> '' AND c.zip_code <> '' AND o.zip_code = c.zip_code)) END AS city FROM crm_contacts AS c",
        "order_months": "SELECT o_orderpriority, year(m)::INT AS year, month(m)::INT AS month FROM (SELECT o_orderpriority, UNNEST(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders GROUP BY o_orderpriority) AS g",
        "last_events": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 10",
        "nested_values": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM events",
        "searches": "SELECT p_partkey, p_name AS keywords, CAST(p_size AS VARCHAR) AS low FROM part",
        "sitemap_tree": "SELECT 'https://x.example/n/' || n_nationkey AS loc FROM nation WHERE n_regionkey <> 4",
    }

"""Queries of transforms, policies, schemas, snapshots and web sources over the driver's tables, with SQL of their own where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import sinks
from rowloom.functions import transforms as tf
from rowloom.operators import html as h
from rowloom.operators import policy as p
from rowloom.operators import schema as sc
from rowloom.operators import snapshots as sn
from rowloom.runtime import table
from rowloom.sources import web
from rowloom.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]


def url_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Links made absolute, parameters dropped and set, page numbers and registered names of the runs' URLs."""
    u = F.col("source_url")
    base = F.regexp_replace(u, r"\?.*$", "")
    rows = table(spark, sf, "scrape_result").where("source_url IS NOT NULL").select("run_id", "source_url").distinct()
    return rows.select(
        "run_id", tf.absolute_url(F.lit("/a/b?x=1"), base).alias("rooted"), tf.absolute_url(F.lit("?q=2"), base).alias("query"), tf.absolute_url(F.lit("//cdn.example/y"), base).alias("host_only"), tf.drop_params(F.concat(base, F.lit("?a=1&sid=9&b=2#f")), ["sid"]).alias("dropped"),
        tf.with_param(F.concat(base, F.lit("?page=1&z=3")), "page", F.lit(7)).alias("paged"), tf.page_number(F.concat(base, F.lit("?x=1&page=12"))).alias("page"), tf.registrable_domain(u).alias("registered"),
    )


def value_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts, currencies, dates and multiplied numbers out of the balances and dates of orders."""
    o = table(spark, sf, "orders")
    price = F.format_number("o_totalprice", 2)
    return o.select(
        "o_orderkey", tf.price(F.concat(F.lit("$ "), price))["amount"].alias("amount"), tf.price(F.concat(price, F.lit(" EUR")))["currency"].alias("currency"), tf.us_date(F.date_format("o_orderdate", "M/d/yyyy")).alias("short_date"),
        tf.date_text(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("long_date"), tf.money(F.concat(F.lit("USD "), price)).alias("digits"), tf.multiplied(F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(".5k"))).alias("thousands"), tf.roll_number(F.concat((F.col("o_orderkey") % 3).cast("string"), F.lit(".0"))).alias("rolled"),
    )


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Letters of the texts of records whose markup is stripped."""
    r = table(spark, sf, "scrape_result").select("run_id", F.posexplode("records").alias("pos", "r")).distinct()
    return r.select("run_id", "pos", F.length(tf.strip_html(F.concat(F.lit("<p class='x'>"), F.col("r.title"), F.lit("</p><!-- note -->")))).alias("letters"))


def cell_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of cells of a sheet made of customers."""
    c = table(spark, sf, "customer").select(F.posexplode(F.array(F.col("c_acctbal").cast("string"), F.col("c_mktsegment"), F.lit("true"), F.lit("2024-01-02"), F.lit("=1+1"), F.lit(""))).alias("k", "v"))
    return c.select("k", tf.cell_value(F.col("v"), "balance")["kind"].alias("kind")).groupBy("k", "kind").count().withColumnRenamed("count", "n")


def record_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of order records: a price under 50,000 or over 300,000, a status that is too short, a missing clerk."""
    o = table(spark, sf, "orders").withColumn("clerk", F.when(F.col("o_orderkey") % 10 > 0, "x"))
    fields = [{"name": "clerk", "required": True}, {"name": "o_totalprice", "minimum": 50000, "maximum": 300000}, {"name": "o_orderpriority", "min_length": 6}]
    return o.select("o_orderkey", F.array_join(p.record_errors(fields), "; ").alias("errors"))


def validated_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The first valid order of every customer and date."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("cust"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return p.validate(o, [{"name": "o_totalprice", "minimum": 50000}], ["cust", "day"], ["o_orderkey"])[0].select("o_orderkey")


def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the runs' URLs are in a scope of hosts and paths."""
    rows = table(spark, sf, "scrape_result").where("source_url IS NOT NULL").select("run_id", "source_url").distinct()
    host = F.regexp_extract("source_url", r"^[a-z]+://([^/?#]+)", 1)
    return rows.select("run_id", p.in_scope(F.concat(F.when(F.col("run_id") % 2 == 0, "https://").otherwise("http://"), host, F.lit("/list/"), F.col("run_id").cast("string")), [r["h"] for r in rows.select(F.lower(host).alias("h")).distinct().collect()], ["^/list"]).alias("inside"))  # a few hosts


def robots_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of rules with wildcards, ends, ties and an agent's own group over order pages."""
    text = "User-agent: *\nDisallow: /o/\nAllow: /o/*1$\nDisallow: /o/9\nAllow: /o/9\n# end\nUser-agent: Loom\nDisallow: /"
    rules = p.robots_rules(spark.createDataFrame([("x.example", text)], "host string, text string"))
    urls = table(spark, sf, "orders").select(F.concat(F.lit("https://x.example/o/"), F.col("o_orderkey").cast("string")).alias("url"))
    return p.robots_allowed(urls, rules).select("url", "allowed")


def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by whether any of their warnings is a refusal."""
    w = table(spark, sf, "scrape_result").select("run_id", F.explode("warnings").alias("w")).distinct()
    return w.groupBy("run_id").agg(F.count_if(p.refusal(F.lit(200), F.col("w")).isNotNull()).alias("refused"))


def role_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Roles proposed for the headers of all tables."""
    headers = [c for n in ("people_export", "crm_contacts", "customer", "scrape_result") for c in table(spark, sf, n).columns] + ["Phnoe Number", "Owner Mailing Zip", "E-Mail", "First Name"]
    found = sc.propose_roles(list(dict.fromkeys(headers)))
    return spark.createDataFrame([(a, b, c, ",".join(d)) for a, b, c, d in found], "header string, role string, confidence string, candidates string")


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of crm_contacts with the values seen first."""
    prof = sc.profile(table(spark, sf, "crm_contacts"), ["full_name", "mobile", "street", "city", "zip_code", "entered_by"], "crm_id")
    return prof.withColumn("sample_values", F.array_join("sample_values", "|"))


def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Flat keys of event properties with a nested object and a list beside them."""
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"props": '), "props", F.lit(', "who": {"id": '), F.col("user_id").cast("string"), F.lit(', "kind": {"type": "literal", "value": "v"}}, "tags": ["a", "b"]}'))
    flat = e.select("event_id", sc.flatten_json(doc).alias("m"))
    return flat.select("event_id", F.col("m")["props.k"].alias("k"), F.col("m")["who.id"].alias("who"), F.col("m")["who.kind"].alias("kind"), F.col("m")["tags"].alias("tags"))


def spread_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Columns spread out of event properties."""
    return sc.spread_json(table(spark, sf, "events").select("event_id", "props"), "props", "Fact: ").drop("props")


def order_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed difference of two snapshots of orders with the fields that changed."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = o.where("o_orderkey % 7 <> 0").withColumn("at", F.lit(1))
    after = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END")).withColumn("at", F.lit(2))
    d = sn.diff_records(before, after, ["o_orderkey"], "at")
    return d.select("key", "change", F.col("changes")["o_orderstatus"]["before"].alias("before"), F.col("changes")["o_orderstatus"]["after"].alias("after"))


def order_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a difference whose later snapshot has rows without a key."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").withColumn("at", F.lit(1))
    after = o.select(F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus", "at")
    return sn.diff_counts(o, after, ["o_orderkey"], "at")


def capture_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between the first and the last event of every user."""
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", "props")
    return sn.compare_captures(e, "user_id", "at", ["event_type", "props"]).withColumnRenamed("url", "user_id")


def health_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of every user's last three events, a value over 50 being a pass."""
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("value") > 50).alias("ok"))
    return sn.consecutive_failures(e, "user_id", "at", "ok")


def crawl_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts reached from part 1 within five steps of links to their doubles and triples."""
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    links = q.select(F.col("k").cast("string").alias("source"), F.explode(F.array((F.col("k") * 2).cast("string"), (F.col("k") * 3 + 1).cast("string"))).alias("target"))
    return sn.crawl(links, ["1"], most_depth=5)


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """State of a job per user, whose events are read as steps of a job."""
    steps = F.element_at(F.array(*[F.lit(x) for x in ("validating", "queued", "running", "completed", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "event_id", steps.alias("state"))
    return sn.replay_jobs(e, {"draft": ["validating"], "validating": ["queued", "failed"], "queued": ["running"], "running": ["completed", "failed"], "failed": ["queued"]})


def unseen_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users and types that no earlier half of the events had."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sn.unseen(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type"]).select("event_id")


def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type."""
    return runs.event_windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]).select(F.unix_timestamp("window_start").alias("at"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every user's events without a pause of twelve hours."""
    s = runs.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", gap="12 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def quad_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of N-Quads lines made of orders: an order with its customer nested in it."""
    o = table(spark, sf, "orders")
    s = F.concat(F.lit("<http://x.example/o/"), F.col("o_orderkey").cast("string"), F.lit(">"))
    b = F.concat(F.lit("_:c"), F.col("o_custkey").cast("string"))
    g = F.concat(F.lit(" <http://x.example/page/"), F.col("o_orderkey").cast("string"), F.lit("> ."))
    typed = F.lit(" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ")
    lines = F.array(
        F.concat(s, typed, F.lit("<http://schema.org/Order>"), g), F.concat(s, F.lit(' <http://schema.org/status> "'), F.col("o_orderstatus"), F.lit('"'), g), F.concat(s, F.lit(" <http://schema.org/customer> "), b, g),
        F.concat(b, typed, F.lit("<http://schema.org/Person>"), g), F.concat(b, F.lit(' <http://schema.org/name> "C \\"'), F.col("o_custkey").cast("string"), F.lit('\\""@en'), g), F.lit("no quad"),
    )
    e = web.entities(web.nquads(o.select(F.explode(lines).alias("value"))))
    return e.select("subject", F.array_join("types", ",").alias("types"), F.col("properties")["status"][0].alias("status"), F.col("properties")["customer.name"][0].alias("customer"))


def capture_index(spark: SparkSession, sf: str) -> DataFrame:
    """Captures of a JSON table with a header row, one per user."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("m"))
    doc = F.concat(F.lit('[["timestamp","original","statuscode"],["2024","http://x.example/'), F.col("user_id").cast("string"), F.lit('","200"],["2025","http://x.example/'), F.col("m").cast("string"), F.lit('","404"]]'))
    return e.select("user_id", F.explode(web.wayback_index(doc)).alias("c")).select("user_id", F.col("c")["timestamp"].alias("timestamp"), F.col("c")["original"].alias("url"), F.col("c")["statuscode"].try_cast("int").alias("status"))


def link_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Links of link lists made of nations, with the headings they stand under."""
    n = table(spark, sf, "nation")
    text = F.concat(F.lit("# Guide\n- [a](/a): first\n## "), "n_name", F.lit("\n* [b](b.html)\n## Optional\n- [c](https://c.example/c): last\nno link"))
    return web.link_list(n.select(F.concat(F.lit("https://x.example/"), F.col("n_nationkey").cast("string")).alias("url"), text.alias("text")), "https://x.example/d/").select("url", "position", "section", "title", "link", "note", "optional")


def page_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of pages made of nations by selectors: title, link and price of every card."""
    n = table(spark, sf, "nation")
    card = lambda k: F.concat(F.lit(f'<div class="card c{k}"><h3><a href="/n/{k}?x=1">'), "n_name", F.lit(f"</a></h3><p class=price>$ {k}.50</p></div>"))
    pages = n.select("n_nationkey", F.concat(F.lit("https://x.example/"), F.col("n_nationkey").cast("string")).alias("url"), F.concat(F.lit("<html><body><nav><a href=/>Home</a></nav>"), card(1), card(2), F.lit("</body></html>")).alias("html"))
    fields = [{"name": "title", "selectors": ["h3 > a::text"]}, {"name": "link", "selectors": ["h3 a::attr(href)"], "type": "url"}, {"name": "price", "selectors": [".missing", "p.price"]}]
    return h.pages_to_rows(pages, "n_nationkey", "url", "html", lambda b, u: h.selector_records(b, u, "div.card", fields), "title string, link string, price string")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages made of nations: absolute, once each, without fragments and those marked."""
    n = table(spark, sf, "nation")
    body = F.concat(F.lit('<base href="/b/"><a href="x#1">x</a><a href="x#2">x</a><a rel=nofollow href=y>y</a><a href="mailto:a@b.example">m</a><a href="//h.example/'), "n_name", F.lit('">h</a>'))
    pages = n.select("n_nationkey", F.lit("https://x.example/a/p").alias("url"), body.alias("html"))
    return h.pages_to_rows(pages, "n_nationkey", "url", "html", lambda b, u: [{"link": x} for x in h.links(b, u)], "link string")


def structured_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products of pages that give them as JSON-LD and as microdata, equal values merged and different ones kept."""
    q = table(spark, sf, "part").where("p_partkey IS NOT NULL")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"'), F.col("p_partkey").cast("string"), F.lit('","name":"'), "p_name", F.lit('","offers":{"@type":"Offer","price":'), F.col("p_size").cast("string"), F.lit("}}]}</script>"))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product"><span itemprop="sku">'), F.col("p_partkey").cast("string"), F.lit('</span><b itemprop="name">'), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")), F.lit("</b></div>"))

    def run(body: str, url: str) -> list[dict]:
        out = []
        for e in h.structured(body):
            out += [{"syntax": e["syntax"], "type": e["type"], "key": h.scalar(e["data"].get("sku")), "field": f, "value": h.scalar(h.json_path(e["data"], path))} for f, path in (("name", "name"), ("price", "offers.price"))]
        return out

    pages = q.select("p_partkey", F.lit("https://x.example/").alias("url"), F.concat(ld, micro).alias("html"))
    found = h.pages_to_rows(pages, "p_partkey", "url", "html", run, "syntax string, type string, key string, field string, value string")
    return h.merge_syntaxes(found, "p_partkey").select("p_partkey", "field", F.array_join("values", "|").alias("values"), "conflict")


def api_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of JSON answers made of nations: arrays beside each other zipped."""
    n = table(spark, sf, "nation")
    doc = F.concat(F.lit('{"data": {"recent": {"id": ['), F.col("n_nationkey").cast("string"), F.lit(', 99], "name": ["'), "n_name", F.lit('", null]}}}'))
    pages = n.select("n_nationkey", F.lit("").alias("url"), doc.alias("body"))
    return h.pages_to_rows(pages, "n_nationkey", "url", "body", lambda b, u: h.json_records(b, "data.recent", {"id": "id", "name": "name"}), "id string, name string")


def feed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of feeds made of regions."""
    r = table(spark, sf, "region")
    doc = F.concat(F.lit("<rss><channel><item><title>"), "r_name", F.lit("</title><link>/i</link><guid>g1</guid><category>a</category><category>b</category></item><item><title>2</title></item></channel></rss>"))
    return web.each(r.select(F.col("r_name").alias("url"), doc.alias("content")), "url", "content", lambda c, u: web.feed_entries(c, "https://x.example/f"), "title string, link string, id string, categories string")


def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of sitemaps made of nations that are new enough."""
    n = table(spark, sf, "nation")
    doc = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.example/'), "n_name", F.lit("</loc><lastmod>2024-0"), (F.col("n_regionkey") + 1).cast("string"), F.lit("-01</lastmod></url><url><loc>https://x.example/old</loc></url></urlset>"))
    rows = web.each(n.select(F.col("n_name").alias("url"), doc.alias("content")), "url", "content", lambda c, u: web.sitemap_entries(c), "kind string, loc string, lastmod string")
    return rows.where(p.changed_since(F.col("lastmod"), "2024-03-01")).select("loc", "lastmod")


def price_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent part types with their share and mean price."""
    b = sinks.breakdown(table(spark, sf, "part"), "p_type", 5, "p_retailprice")
    return b.select("value", "n", F.round("share", 6).alias("share"), F.round("average", 4).alias("average"))


def photo_list(spark: SparkSession, sf: str) -> DataFrame:
    """One row per address in a column of addresses."""
    q = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" http://a.example/1  x https://a.example/"), F.col("p_partkey").cast("string")).alias("photos"))
    return sinks.photo_rows(q, "p_partkey", "photos")


_U = "regexp_replace(source_url, '\\?.*$', '')"
_ORIGIN = "regexp_extract(source_url, '^([a-z]+://[^/?#]*)', 1)"


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            url_transforms, value_transforms, html_text, cell_kinds, record_checks, validated_orders, scope_filter, robots_decisions, refusals, role_proposals, table_profile, json_keys, spread_properties, order_diff, order_diff_counts, capture_changes,
            health_failures, crawl_levels, job_states, unseen_events, hourly_windows, user_sessions, quad_entities, capture_index, link_sections, page_records, page_links, structured_products, api_records, feed_records, sitemap_pages, price_breakdown, photo_list,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "url_transforms": f"""SELECT DISTINCT run_id, {_ORIGIN} || '/a/b?x=1' AS rooted, {_U} || '?q=2' AS query, split_part(source_url, '//', 1) || '//cdn.example/y' AS host_only, lower({_ORIGIN}) || substr({_U}, length({_ORIGIN}) + 1) || '?a=1&b=2' AS dropped,
            {_U} || '?z=3&page=7' AS paged, 12 AS page, array_to_string(list_slice(string_split(split_part({_ORIGIN}, '//', 2), '.'), -2, -1), '.') AS registered FROM scrape_result WHERE source_url IS NOT NULL""",
        "value_transforms": "SELECT o_orderkey, printf('%.2f', o_totalprice) AS amount, 'EUR' AS currency, strftime(o_orderdate, '%Y-%m-%d') AS short_date, strftime(o_orderdate, '%Y-%m-%d') AS long_date, printf('%.2f', o_totalprice) AS digits, CAST(((o_orderkey % 90) + 0.5) * 1000 AS DOUBLE) AS thousands, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS rolled FROM orders",
        "cell_kinds": "SELECT k, kind, CAST((SELECT COUNT(*) FROM customer) AS BIGINT) AS n FROM (VALUES (0, 'number'), (1, 'text'), (2, 'flag'), (3, 'date'), (4, 'text'), (5, 'empty')) AS t(k, kind)",
        "record_checks": "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'clerk is required' END, CASE WHEN o_totalprice < 50000 THEN 'o_totalprice is below 50000' END, CASE WHEN o_totalprice > 300000 THEN 'o_totalprice is above 300000' END, CASE WHEN length(o_orderpriority) < 6 THEN 'o_orderpriority is too short' END], lambda x: x IS NOT NULL), '; ') AS errors FROM orders",
        "validated_orders": "WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS cust, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice >= 50000) SELECT o_orderkey FROM o WHERE cust IS NULL UNION ALL SELECT min(o_orderkey) FROM o WHERE cust IS NOT NULL GROUP BY cust, day",
        "scope_filter": "SELECT DISTINCT run_id, run_id % 2 = 0 AS inside FROM scrape_result WHERE source_url IS NOT NULL",
        "robots_decisions": "SELECT 'https://x.example/o/' || o_orderkey AS url, (o_orderkey % 10 = 1 OR starts_with(CAST(o_orderkey AS VARCHAR), '9')) AS allowed FROM orders",
        "refusals": "SELECT run_id, CAST(SUM(CASE WHEN " + " OR ".join(f"contains(lower(w), '{x}')" for x in ("captcha", "are you a robot", "verify you are human", "unusual traffic", "access denied", "cf-challenge", "enable javascript and cookies to continue", "request blocked", "bot detection")) + " THEN 1 ELSE 0 END) AS BIGINT) AS refused FROM (SELECT DISTINCT run_id, UNNEST(warnings) AS w FROM scrape_result) AS x GROUP BY run_id",
        "table_profile": """WITH v AS (SELECT crm_id, UNNEST(['full_name', 'mobile', 'street', 'city', 'zip_code', 'entered_by']) AS column_name, UNNEST([full_name, mobile, street, city, zip_code, entered_by]) AS value FROM crm_contacts), f AS (SELECT column_name, value, min(crm_id) AS seen FROM v WHERE value <> '' GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY seen, value) AS k FROM f)
            SELECT v.column_name, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE value IS NULL OR value = '') AS null_count, COUNT(DISTINCT value) FILTER (WHERE value <> '') AS distinct_count, (SELECT string_agg(s.value, '|' ORDER BY k) FROM s WHERE s.column_name = v.column_name AND k <= 5) AS sample_values FROM v GROUP BY v.column_name""",
        "json_keys": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS who, 'v' AS kind, 'a, b' AS tags FROM events",
        "spread_properties": "SELECT event_id, json_extract_string(props, '$.k') AS \"Fact: k\" FROM events",
        "order_diff": """WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)
            SELECT '{"o_orderkey":' || coalesce(a.k, b.k) || '}' AS key, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN a.s <> b.s THEN b.s END AS before, CASE WHEN a.s <> b.s THEN a.s END AS after FROM b FULL JOIN a ON a.k = b.k""",
        "order_diff_counts": "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE 'unchanged' END AS change, COUNT(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'unkeyed', COUNT(*) FROM orders WHERE o_orderkey % 13 = 0",
        "capture_changes": "WITH e AS (SELECT user_id, first(event_type ORDER BY ts, event_id) AS t1, last(event_type ORDER BY ts, event_id) AS t2, first(props ORDER BY ts, event_id) AS p1, last(props ORDER BY ts, event_id) AS p2 FROM events GROUP BY user_id HAVING COUNT(*) >= 2) SELECT user_id, concat_ws(',', CASE WHEN t1 IS DISTINCT FROM t2 THEN 'event_type' END, CASE WHEN p1 IS DISTINCT FROM p2 THEN 'props' END) AS changed FROM e",
        "health_failures": "WITH r AS (SELECT user_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), f AS (SELECT user_id, CAST(coalesce(min(k) FILTER (WHERE ok) - 1, COUNT(*)) AS INT) AS failures FROM r WHERE k <= 3 GROUP BY user_id) SELECT user_id, failures, CASE WHEN failures >= 3 THEN 'disabled' ELSE 'active' END AS status FROM f",
        "crawl_levels": "WITH RECURSIVE l AS (SELECT p_partkey AS a, UNNEST([p_partkey * 2, p_partkey * 3 + 1]) AS b FROM part), w(url, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT l.b, depth + 1 FROM w JOIN l ON l.a = w.url WHERE depth < 5) SELECT CAST(url AS VARCHAR) AS url, min(depth) AS depth FROM w GROUP BY url",
        "unseen_events": "SELECT event_id FROM events AS e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events AS s WHERE s.event_id % 2 = 0 AND s.user_id = e.user_id AND s.event_type = e.event_type)",
        "hourly_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS at, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY ALL",
        "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS start FROM events), s AS (SELECT user_id, SUM(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, COUNT(*) AS n FROM s GROUP BY ALL) SELECT user_id, COUNT(*) AS sessions, MAX(n) AS longest FROM n GROUP BY user_id",
        "quad_entities": "SELECT 'http://x.example/o/' || o_orderkey AS subject, 'Order' AS types, o_orderstatus AS status, 'C \"' || o_custkey || '\"' AS customer FROM orders",
        "capture_index": "WITH e AS (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id) SELECT user_id, '2024' AS timestamp, 'http://x.example/' || user_id AS url, 200 AS status FROM e UNION ALL SELECT user_id, '2025', 'http://x.example/' || m, 404 FROM e",
        "link_sections": "SELECT 'https://x.example/' || n_nationkey AS url, position, CASE position WHEN 1 THEN 'Guide' WHEN 3 THEN n_name ELSE 'Optional' END AS section, title, link, note, position = 5 AS optional FROM nation, (VALUES (1, 'a', 'https://x.example/a', 'first'), (3, 'b', 'https://x.example/d/b.html', ''), (5, 'c', 'https://c.example/c', 'last')) AS l(position, title, link, note)",
        "page_records": "SELECT n_nationkey, n_name AS title, 'https://x.example/n/' || k || '?x=1' AS link, '$ ' || k || '.50' AS price FROM nation, (VALUES (1), (2)) AS c(k)",
        "page_links": "SELECT n_nationkey, UNNEST(['https://x.example/b/x', 'https://h.example/' || n_name]) AS link FROM nation",
        "structured_products": "SELECT p_partkey, 'name' AS field, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || '|' || p_name END AS values, p_partkey % 2 <> 0 AS conflict FROM part UNION ALL SELECT p_partkey, 'price', CAST(p_size AS VARCHAR), FALSE FROM part",
        "api_records": "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey, '99', NULL FROM nation",
        "feed_records": "SELECT r_name AS url, r_name AS title, 'https://x.example/i' AS link, 'g1' AS id, 'a, b' AS categories FROM region UNION ALL SELECT r_name, '2', NULL, NULL, '' FROM region",
        "sitemap_pages": "SELECT 'https://x.example/' || n_name AS loc, '2024-0' || (n_regionkey + 1) || '-01' AS lastmod FROM nation WHERE n_regionkey >= 2",
        "price_breakdown": "SELECT p_type AS value, COUNT(*) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM part WHERE p_type <> ''), 6) AS share, round(AVG(p_retailprice), 4) AS average FROM part WHERE p_type <> '' GROUP BY p_type ORDER BY n DESC, value LIMIT 5",
        "photo_list": "SELECT p_partkey, 0 AS position, 'http://a.example/1' AS url FROM part UNION ALL SELECT p_partkey, 2, 'https://a.example/' || p_partkey FROM part",
    }

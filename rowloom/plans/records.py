"""Queries of the record operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions import text as t
from rowloom.operators import relational as r
from rowloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_RAW = "trim(regexp_replace(lower({0}), '[\\s,;]*(ext\\.?|x|extension)[ .]*[0-9]+\\s*$', ''))"
_DIGITS = f"regexp_replace({_RAW}, '[^0-9]', '', 'g')"
_E164 = f"CASE WHEN length({_DIGITS}) < 7 THEN NULL WHEN length({_DIGITS}) = 10 AND NOT starts_with({_RAW}, '+') THEN '+1' || {_DIGITS} WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN '+' || {_DIGITS} WHEN starts_with({_RAW}, '+') THEN '+' || {_DIGITS} ELSE {_DIGITS} END"


@_query(f"SELECT row_id, {_E164.format('phone')} AS e164 FROM people_export")
def norm_phone(spark: SparkSession, sf: str) -> DataFrame:
    """Telephone numbers in comparable form."""
    return table(spark, sf, "people_export").select("row_id", t.phone(F.col("phone")).alias("e164"))


@_query(
    f"""SELECT row_id, CASE WHEN regexp_full_match(e, '\\+1[0-9]{{10}}') AND length(replace(substr(e, 3), substr(e, 3, 1), '')) > 0 AND substr(e, 3) NOT IN ('1234567890', '0123456789', '0987654321') AND NOT ends_with(e, '0000000')
        THEN '(' || substr(e, 3, 3) || ') ' || substr(e, 6, 3) || '-' || substr(e, 9, 4) END AS shown FROM (SELECT row_id, {_E164.format('phone')} AS e FROM people_export) AS x"""
)
def norm_phone_display(spark: SparkSession, sf: str) -> DataFrame:
    """Telephone numbers for display."""
    return table(spark, sf, "people_export").select("row_id", t.phone_display(F.col("phone")).alias("shown"))


_MAILBOX = """CASE WHEN regexp_matches({0}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN
    CASE WHEN split_part({0}, '@', 2) IN ('gmail.com', 'googlemail.com') THEN replace(coalesce(nullif(split_part(split_part({0}, '@', 1), '+', 1), ''), split_part({0}, '@', 1)), '.', '') || '@gmail.com'
         WHEN split_part({0}, '@', 2) IN ('outlook.com', 'hotmail.com', 'live.com', 'msn.com', 'icloud.com', 'me.com', 'mac.com', 'fastmail.com', 'protonmail.com', 'proton.me') THEN coalesce(nullif(split_part(split_part({0}, '@', 1), '+', 1), ''), split_part({0}, '@', 1)) || '@' || split_part({0}, '@', 2)
         ELSE {0} END END"""
#: every address as it is, at a provider of plus tags with one added, and at one that ignores dots
_MAILS = "(SELECT row_id, kind, CASE kind WHEN 0 THEN m WHEN 1 THEN split_part(m, '@', 1) || '+news@outlook.com' ELSE split_part(m, '@', 1) || '+x@GoogleMail.com' END AS mail FROM (SELECT row_id, lower(trim(email)) AS m FROM people_export) AS a, (VALUES (0), (1), (2)) AS k(kind))"


@_query(f"SELECT row_id, kind, {_MAILBOX.format('lower(mail)')} AS mailbox FROM {_MAILS} AS x")
def norm_email(spark: SparkSession, sf: str) -> DataFrame:
    """Mailbox identities of all addresses, as they are and as tagged addresses of two providers."""
    local = F.substring_index("m", "@", 1)
    variants = F.array(F.col("m"), F.concat(local, F.lit("+news@outlook.com")), F.concat(local, F.lit("+x@GoogleMail.com")))
    rows = table(spark, sf, "people_export").select("row_id", F.lower(F.trim("email")).alias("m")).select("row_id", F.posexplode(variants).alias("kind", "mail"))
    return rows.select("row_id", "kind", t.email(F.col("mail")).alias("mailbox"))


_BARE_ZIP = "regexp_replace(zip, '[  ]', '', 'g')"


@_query(
    f"""SELECT row_id, CASE WHEN {_BARE_ZIP} = '' THEN NULL WHEN regexp_full_match({_BARE_ZIP}, '[0-9]{{5}}(-?[0-9]{{4}})?') THEN substr({_BARE_ZIP}, 1, 5) ELSE upper({_BARE_ZIP}) END AS code,
        CASE WHEN regexp_full_match(regexp_replace(trim(zip), '\\.0$', ''), '[0-9]{{3,5}}') THEN lpad(regexp_replace(trim(zip), '\\.0$', ''), 5, '0')
             WHEN regexp_full_match(regexp_replace(trim(zip), '\\.0$', ''), '[0-9]{{5}}-?[0-9]{{4}}') THEN substr(trim(zip), 1, 5) END AS restored FROM people_export"""
)
def norm_postal_code(spark: SparkSession, sf: str) -> DataFrame:
    """Postal codes for comparison, and restored from lost zeros and decimals."""
    return table(spark, sf, "people_export").select("row_id", t.postal_code(F.col("zip")).alias("code"), t.restored_zip(F.col("zip")).alias("restored"))


_LEGAL = "'inc', 'incorporated', 'llc', 'llp', 'lp', 'ltd', 'limited', 'corp', 'corporation', 'co', 'company', 'plc', 'gmbh', 'ag', 'sa', 'sas', 'srl', 'bv', 'nv', 'pty', 'pllc', 'pc', 'the'"
_SPLIT = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: w <> '')"
_FP = f"array_to_string(list_sort(list_distinct({_SPLIT.format("regexp_replace(lower(strip_accents(replace(name, chr(160), ' '))), '[^a-z0-9_\\s]', '', 'g')")})), ' ')"
_CO = f"array_to_string(list_sort(list_distinct(list_filter({_SPLIT.format("regexp_replace(lower(strip_accents(replace(name, chr(160), ' '))), '[^a-z0-9_\\s&]', ' ', 'g')")}, lambda w: w NOT IN ({_LEGAL})))), ' ')"


@_query(f"SELECT row_id, {_FP} AS fp, {_CO} AS company FROM people_export")
def key_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Key-collision keys of names."""
    return table(spark, sf, "people_export").select("row_id", t.fingerprint(F.col("name")).alias("fp"), t.company_key(F.col("name")).alias("company"))


_COMPACT = "regexp_replace(lower(strip_accents(replace(name, chr(160), ' '))), '[^a-z0-9]+', '', 'g')"


@_query(f"SELECT row_id, CASE WHEN name IS NOT NULL THEN coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length({_COMPACT}) - 1, 1) + 1), lambda i: substr({_COMPACT}, i, 2)))), ''), '') END AS grams FROM people_export")
def key_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Bigram keys of names."""
    return table(spark, sf, "people_export").select("row_id", t.ngram_fingerprint(F.col("name")).alias("grams"))


@_query(
    f"""SELECT column_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE value IS NULL OR value = '') AS empty, COUNT(*) FILTER (WHERE lower(trim(value)) IN ('n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', '#n/a', '#value!', '#ref!', '#div/0!', '#name?', '#null!', '#num!', '-', '--', '---', '?', '??', 'unknown', 'not available', 'not applicable', 'tbd', 'undefined', 'blank', 'empty')) AS stand_ins
        FROM (SELECT UNNEST(['name', 'phone', 'email', 'address', 'zip']) AS column_name, UNNEST([name, phone, email, address, zip]) AS value FROM people_export) AS v GROUP BY column_name"""
)
def scan_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """Empty values and stand-ins by column."""
    cols = ["name", "phone", "email", "address", "zip"]
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cols])).alias("e")
    v = table(spark, sf, "people_export").select(cell).select("e.*")
    return v.groupBy("column_name").agg(F.count("*").alias("n"), F.count_if(t.is_empty(F.col("value"))).alias("empty"), F.count_if(t.is_placeholder(F.col("value"))).alias("stand_ins"))


_SHAPED = "SELECT event_id, k, v FROM (SELECT event_id, UNNEST([0, 1, 2, 3, 4]) AS k, UNNEST([props, '$ ' || CAST(user_id AS VARCHAR), CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d'), CASE WHEN event_id % 2 = 0 THEN 'https://x.example/' || event_type END]) AS v FROM events) AS x"


@_query(
    f"""SELECT event_id, k, CASE WHEN coalesce(trim(v), '') = '' THEN 'empty' WHEN regexp_matches(trim(v), '^[$€£¥] ?[0-9]') THEN 'currency' WHEN regexp_full_match(trim(v), '-?[0-9][0-9,]*(\\.[0-9]+)?') THEN 'number'
       WHEN regexp_matches(trim(v), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date' WHEN starts_with(trim(v), 'https://') THEN 'url' ELSE 'text' END AS shape,
       nullif(regexp_extract(replace(v, ',', ''), '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS first_number FROM ({_SHAPED}) AS y"""
)
def value_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Shape and first number of event properties, amounts, numbers, dates and addresses."""
    kinds = F.array(F.col("props"), F.concat(F.lit("$ "), F.col("user_id").cast("string")), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://x.example/"), "event_type")))
    v = table(spark, sf, "events").select("event_id", F.posexplode(kinds).alias("k", "v"))
    return v.select("event_id", "k", t.shape(F.col("v")).alias("shape"), t.parse_decimal(F.col("v")).alias("first_number"))


@_query(
    """SELECT crm_id, regexp_replace(regexp_replace(regexp_replace(mobile, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}', '[phone]', 'g'), '[0-9]{9,}', '[number]', 'g') AS redacted,
       CASE WHEN length(full_name) <= 4 THEN repeat('•', length(full_name)) ELSE substr(full_name, 1, 1) || repeat('•', length(full_name) - 3) || right(full_name, 2) END AS masked FROM crm_contacts"""
)
def redact_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted telephones and masked names."""
    return table(spark, sf, "crm_contacts").select("crm_id", t.redact(F.col("mobile")).alias("redacted"), t.mask(F.col("full_name")).alias("masked"))


@_query("SELECT run_id, lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_replace(source_url, '^[A-Za-z]+://', '') AS canonical FROM scrape_result")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts and canonical forms of collected URLs (one parameter at most, no tracking in these tables)."""
    return table(spark, sf, "scrape_result").select("run_id", t.host_of(F.col("source_url")).alias("host"), t.canonical_url(F.col("source_url")).alias("canonical"))


_TIDY = "coalesce(lower(trim(regexp_replace(regexp_replace(translate({0}, ' ', ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f​-‍﻿]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))), '')"


@_query(f"SELECT row_id, row_number() OVER (PARTITION BY {', '.join(_TIDY.format(c) for c in ('name', 'phone', 'address', 'zip'))} ORDER BY row_id) - 1 AS copy FROM people_export")
def exact_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of rows after tidying, numbered."""
    return r.exact_duplicates(table(spark, sf, "people_export"), ["name", "phone", "address", "zip"], ["row_id"]).select("row_id", "copy")


@_query(
    f"""WITH c AS (SELECT {_FP} AS key, name AS value, COUNT(*) AS n FROM people_export WHERE name <> '' GROUP BY ALL)
        SELECT key, first(value ORDER BY n DESC, (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')) DESC, length(value), hex(encode(value)) DESC) AS preferred, COUNT(*) AS variants, SUM(n)::BIGINT AS rows FROM c WHERE key <> '' GROUP BY key HAVING COUNT(*) > 1"""
)
def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of names that collide under their fingerprint, with the preferred one."""
    return r.variant_groups(table(spark, sf, "people_export"), "name", t.fingerprint(F.col("name")))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "people_export")
    return r.block_keys(people, "row_id", {"phone": F.when(t.phone(F.col("phone")).rlike(r"^\+1[0-9]{10}$"), t.phone(F.col("phone"))), "email": t.email(F.col("email"))})


_BLOCKS = f"""b AS (SELECT row_id, 'phone:' || e AS block FROM (SELECT row_id, {_E164.format('phone')} AS e FROM people_export) AS x WHERE regexp_full_match(e, '\\+1[0-9]{{10}}')
    UNION ALL SELECT row_id, 'email:' || lower(trim(email)) FROM people_export WHERE regexp_matches(lower(trim(email)), '^[^@ ]+@[^@ ]+\\.[^@ .]+$')), s AS (SELECT block, COUNT(*) AS size FROM b GROUP BY block)"""


@_query(f"WITH {_BLOCKS} SELECT l.row_id AS left_row_id, x.row_id AS right_row_id, COUNT(*) AS blocks FROM b AS l JOIN b AS x ON l.block = x.block AND l.row_id < x.row_id JOIN s ON s.block = l.block AND s.size <= 60 GROUP BY l.row_id, x.row_id")
def block_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs from telephone and e-mail blocks of at most 60 rows."""
    return r.candidate_pairs(_blocks(spark, sf), 60).withColumnsRenamed({"left": "left_row_id", "right": "right_row_id"})


@_query(f"WITH {_BLOCKS} SELECT block, size FROM s WHERE size > 8")
def block_oversized(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that a limit of 8 rows leaves unpaired."""
    return r.oversized_blocks(_blocks(spark, sf), 8)


@_query(
    """WITH d AS (SELECT DISTINCT * FROM decisions) SELECT job_id, COUNT(*) FILTER (WHERE decision = 'match') AS matches, COUNT(*) FILTER (WHERE decision = 'possible_match') AS possible, COUNT(*) FILTER (WHERE decision = 'non_match') AS apart,
       COUNT(*) FILTER (WHERE decision = 'rejected') AS rejected, round(AVG(score), 6) AS mean_score, MAX(likelihood) AS best FROM d GROUP BY job_id"""
)
def job_results(spark: SparkSession, sf: str) -> DataFrame:
    """Decision counts and scores of every job."""
    d = table(spark, sf, "decisions").distinct()
    by = lambda k: F.count_if(F.col("decision") == k)
    return d.groupBy("job_id").agg(by("match").alias("matches"), by("possible_match").alias("possible"), by("non_match").alias("apart"), by("rejected").alias("rejected"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("likelihood").alias("best"))


@_query(
    """WITH d AS (SELECT DISTINCT * FROM decisions) SELECT decision_id, left_row_id, right_row_id, score FROM d WHERE decision = 'possible_match' AND NOT EXISTS (SELECT 1 FROM d AS s WHERE s.decision IN ('match', 'rejected')
       AND least(s.left_row_id, s.right_row_id) = least(d.left_row_id, d.right_row_id) AND greatest(s.left_row_id, s.right_row_id) = greatest(d.left_row_id, d.right_row_id))"""
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Possible matches that nobody has settled."""
    d = table(spark, sf, "decisions").distinct()
    return r.pending_reviews(d, d.where("decision IN ('match', 'rejected')")).select("decision_id", "left_row_id", "right_row_id", "score")


@_query(
    """WITH d AS (SELECT DISTINCT * FROM decisions WHERE decision = 'possible_match') SELECT job_id, decision_id, place FROM (SELECT job_id, decision_id, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(likelihood, -1) DESC, coalesce(score, -1) DESC, decision_id) AS place FROM d) AS x WHERE place <= 3"""
)
def review_order(spark: SparkSession, sf: str) -> DataFrame:
    """The three most likely possible matches of every job, in review order."""
    w = Window.partitionBy("job_id").orderBy(F.coalesce("likelihood", F.lit(-1.0)).desc(), F.coalesce("score", F.lit(-1.0)).desc(), "decision_id")
    d = table(spark, sf, "decisions").where("decision = 'possible_match'").distinct()
    return d.select("job_id", "decision_id", F.row_number().over(w).alias("place")).where("place <= 3")


@_query("SELECT round(median(date_diff('second', decided_at, loaded_at)), 3) AS seconds, COUNT(*) AS n FROM (SELECT DISTINCT * FROM decisions) AS d WHERE decided_at IS NOT NULL AND loaded_at IS NOT NULL")
def review_turnaround(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median of the seconds from decision to arrival."""
    d = table(spark, sf, "decisions").distinct().where("decided_at IS NOT NULL AND loaded_at IS NOT NULL")
    waited = d.select((F.unix_timestamp(F.col("loaded_at").cast("timestamp")) - F.unix_timestamp(F.col("decided_at").cast("timestamp"))).alias("s"))
    return r.medians(waited, [], "s").select(F.round("median", 3).alias("seconds"), "n")


_COVERAGE = "SELECT load_id, column_name, round(AVG(CASE WHEN value IS NULL OR value = '' THEN 0.0 ELSE 1.0 END), 3) AS coverage FROM (SELECT load_id, dataset_id, UNNEST(['name', 'phone', 'email', 'address', 'zip']) AS column_name, UNNEST([name, phone, email, address, zip]) AS value FROM people_export) AS v GROUP BY load_id, column_name"


@_query(_COVERAGE)
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of filled values by load and column."""
    return r.coverage(table(spark, sf, "people_export"), ["name", "phone", "email", "address", "zip"], ["load_id"])


@_query(f"WITH c AS ({_COVERAGE}) SELECT n.load_id, n.column_name, b.coverage AS was, n.coverage AS now FROM c AS n JOIN c AS b ON b.load_id = n.load_id - 1 AND b.column_name = n.column_name WHERE b.coverage - n.coverage > 0.2")
def coverage_falls(spark: SparkSession, sf: str) -> DataFrame:
    """Columns whose coverage fell by more than a fifth from one load to the next."""
    now = field_coverage(spark, sf)
    return r.coverage_drift(now.withColumn("load_id", F.col("load_id") + 1), now, ["load_id"])


@_query(
    """WITH b AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)
       SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'changed' ELSE 'unchanged' END AS change,
       CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey"""
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed difference of two snapshots of orders, made from the whole table."""
    o = table(spark, sf, "orders")
    before, after = o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END"))
    return r.record_diff(before, after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@_query(
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(MIN(l_extendedprice), 2) AS least, median(l_extendedprice) AS middle, round(AVG(l_extendedprice), 2) AS mean, round(MAX(l_extendedprice), 2) AS most, round(COUNT(*) / (SELECT COUNT(*) FROM lineitem), 6) AS share
       FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def summary_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Key figures of line items by flag and status, with their share of all rows."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    p = F.col("l_extendedprice")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.min(p), 2).alias("least"), F.round(F.avg(p), 2).alias("mean"), F.round(F.max(p), 2).alias("most"))
    total = li.agg(F.count("*").alias("total"))
    g = g.join(r.medians(li, ["l_returnflag", "l_linestatus"], "l_extendedprice").select("l_returnflag", "l_linestatus", F.col("median").alias("middle")), ["l_returnflag", "l_linestatus"])
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")  # one row


@_query("SELECT run_id, host, item_pos, title FROM (SELECT *, row_number() OVER (PARTITION BY host, title ORDER BY run_id, item_pos) AS k FROM (SELECT run_id, regexp_extract(source_url, '^[a-z]+://([^/]+)', 1) AS host, generate_subscripts(records, 1) - 1 AS item_pos, UNNEST(records).title AS title FROM (SELECT DISTINCT ON (run_id) * FROM scrape_result) AS d) AS x) AS y WHERE k = 1 OR title IS NULL OR title = ''")
def unique_records(spark: SparkSession, sf: str) -> DataFrame:
    """First record of every title of a host; untitled records all stay."""
    s = table(spark, sf, "scrape_result").dropDuplicates(["run_id"])
    x = s.select("run_id", F.regexp_extract("source_url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.posexplode("records").alias("item_pos", "rec")).select("run_id", "host", "item_pos", F.col("rec.title").alias("title"))
    return r.first_by_key(x, ["host", "title"], ["run_id", "item_pos"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Queries of cleanup, likelihood and review over the driver's tables, with SQL of their own where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import normalize as nz
from rowloom.functions import text as t
from rowloom.operators import cleanup as c
from rowloom.operators import likelihood as lh
from rowloom.operators import matching as m
from rowloom.operators import review
from rowloom.plans.matching import _NORMAL
from rowloom.runtime import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
ROLES = {"name": "name", "phone": "phone", "email": "email", "address": "address", "zip": "postal_code"}


def _standard(spark: SparkSession, sf: str, name: str, key: str, column: str | Column, role: str, person: bool = True) -> DataFrame:
    rows = table(spark, sf, name).select(key, c.standardize(F.col(column) if isinstance(column, str) else column, role, person=person).alias("s"))
    return rows.select(key, "s.value", "s.problem")


def clean_phones(spark: SparkSession, sf: str) -> DataFrame:
    """Telephones in their written form."""
    return _standard(spark, sf, "people_export", "row_id", "phone", "phone")


def clean_emails(spark: SparkSession, sf: str) -> DataFrame:
    """Mail addresses in their written form, in brackets and with a misspelt domain for every third row."""
    e = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("<mailto:"), F.substring_index("email", "@", 1), F.lit("@gmial.com>"))).otherwise(F.col("email"))
    return _standard(spark, sf, "people_export", "row_id", e, "email")


def clean_zips(spark: SparkSession, sf: str) -> DataFrame:
    """Postal codes in their written form."""
    return _standard(spark, sf, "people_export", "row_id", "zip", "postal_code")


def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of people in their written form."""
    return _standard(spark, sf, "people_export", "row_id", "name", "name")


def clean_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses in their written form."""
    return _standard(spark, sf, "people_export", "row_id", "address", "address")


def clean_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as they come out of a spreadsheet: with a decimal, or shortened to a power of ten."""
    k = F.col("o_orderkey")
    return _standard(spark, sf, "orders", "o_orderkey", F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 7 == 0, F.concat(k.cast("string"), F.lit("E+11"))).otherwise(F.concat(F.lit(" "), k.cast("string"))), "identifier")


def clean_states(spark: SparkSession, sf: str) -> DataFrame:
    """States by name and code, and what is no state in title case."""
    s = F.element_at(F.array(F.lit("new york"), F.lit("N.Y."), F.lit("tx"), F.lit("Puerto Rico"), F.lit("UPPER AUSTRIA"), F.col("n_name")), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return _standard(spark, sf, "nation", "n_nationkey", s, "region")


def clean_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs with and without scheme, in upper case and with blanks."""
    u = F.col("source_url")
    typed = F.when(F.col("run_id") % 3 == 0, F.regexp_replace(u, "^[a-z]+://", "")).when(F.col("run_id") % 5 == 0, F.concat(u, F.lit(" x"))).otherwise(F.concat(F.upper(F.substring(u, 1, 12)), F.substring(u, 13, 10000)))
    return _standard(spark, sf, "scrape_result", "run_id", typed, "url").distinct()


def cleanup_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What cleanup would change in people_export."""
    return c.scan(table(spark, sf, "people_export"), ROLES)


def cleanup_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first changes and problems of every column of people_export."""
    return c.scan_examples(table(spark, sf, "people_export"), ROLES, "row_id")


def cleanup_junk(spark: SparkSession, sf: str) -> DataFrame:
    """Empty, repeated and test rows of people_export."""
    return c.junk_rows(table(spark, sf, "people_export"), list(ROLES), ROLES)


def cleanup_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of crm_contacts in which spellings are worth a look."""
    rows = table(spark, sf, "crm_contacts").select("full_name", "mobile", "street", "city", "zip_code", "entered_by")
    found = c.cluster_columns(rows, rows.columns, {"full_name": "name", "mobile": "phone", "street": "address", "city": "city", "zip_code": "postal_code"})
    return spark.createDataFrame([(x,) for x in found], "column_name string")


def spelling_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All spelling groups of the priorities of orders, typed in three ways."""
    v, k = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    return c.value_clusters(table(spark, sf, "orders").select(F.when(k == 0, F.upper(v)).when(k == 1, F.replace(v, F.lit("-"), F.lit(" "))).otherwise(v).alias("typed")), "typed", limit=None)


def company_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All spelling groups of the names of people_export as companies."""
    return c.value_clusters(table(spark, sf, "people_export"), "name", company=True, limit=None)


def _plan() -> dict:
    return {"standardize": ["phone", "zip"], "clear_invalid": ["email", "phone"], "drop_rows": ["empty", "exact_duplicates", "test"], "merge_values": [{"column": "zip", "values": ["00000", "0"], "to": ""}]}


def cleanup_apply(spark: SparkSession, sf: str) -> DataFrame:
    """people_export after a plan."""
    return c.apply(table(spark, sf, "people_export").select("row_id", *ROLES), ROLES, _plan(), "row_id")[0]


def cleanup_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What the plan changed, cleared, merged and dropped."""
    return c.apply(table(spark, sf, "people_export").select("row_id", *ROLES), ROLES, _plan(), "row_id")[1]


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    rows = scratch.cut(nz.normalized(table(spark, sf, "people_export"), "row_id", ROLES))
    return scratch.cut(m.decide(m.compare(m.candidates(m.block_keys(rows, person=True)), rows, person=True))), rows


def pair_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Likelihood of every decision of a run over people_export."""
    d, rows = _decided(spark, sf)
    return lh.likelihood(d, rows, person=True)


def value_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the rows that have each telephone, mailbox and address."""
    rows = nz.normalized(table(spark, sf, "people_export"), "row_id", ROLES)
    return lh.value_shares(rows).where("kind IN ('phone', 'email', 'address')").select("kind", "value", F.round("share", 9).alias("share"))


def review_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Pending pairs of a run that can be decided together."""
    d, rows = _decided(spark, sf)
    likely = lh.likelihood(d, rows, person=True)
    none = spark.createDataFrame([], "left string, right string, revoked_at timestamp")
    return review.bands(review.pending(d, none).join(likely, "decision_id"))


def ranking_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking of every decision by weights learned from the run's certain decisions as labels of 200 pairs."""
    d, _ = _decided(spark, sf)
    vector = d.select("decision_id", "decision", lh.features(F.col("evidence"), F.col("score")).alias("v"))
    labels = vector.where("decision <> 'possible_match'").orderBy("decision_id").limit(200).collect()  # reviewers label a few hundred pairs
    model = lh.train([(r["v"], int(r["decision"] == "match")) for r in labels])
    return vector.select("decision_id", F.round(lh.predict(model["weights"], F.col("v")), 6).alias("ranking"))


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    """Sound codes of the words of part names."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", t.soundex(F.col("word")).alias("sound"))


def queue_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten of the pending decisions, most likely first."""
    d = table(spark, sf, "decisions").distinct().where("decision = 'possible_match'")
    return review.queue(d, "likelihood", 10, 10).select("decision_id")


def latest_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """The newest override of every dataset that is in effect."""
    o = review.in_effect(table(spark, sf, "canonical_overrides")).groupBy("dataset_id").agg(F.max(F.struct("created_at", "override_id")).alias("m"))
    return o.select("dataset_id", "m.override_id")


def split_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """The links that a split of the nations of region 1 from the others forbids."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("row_id"), "n_regionkey")
    chosen = [r["row_id"] for r in n.where("n_regionkey = 1").collect()]  # a person's selection
    return review.split(n.select("row_id"), chosen)


_TIDY = "trim(regexp_replace(replace({0}, chr(160), ' '), '\\s+', ' ', 'g'))"
_STAND_INS = "'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', '#n/a', '#value!', '#ref!', '#div/0!', '#name?', '#null!', '#num!', '-', '--', '---', '?', '??', 'unknown', 'not available', 'not applicable', 'tbd', 'undefined', 'blank', 'empty'"
_JUDGED = "CASE WHEN v = '' THEN NULL WHEN lower(v) IN ({s}) THEN 'placeholder' ELSE {0} END AS problem, CASE WHEN v = '' OR lower(v) IN ({s}) THEN v ELSE {1} END AS value".replace("{s}", _STAND_INS)
_PHONES = f"""SELECT row_id, {_JUDGED.format(
    "CASE WHEN d = '' THEN 'invalid' WHEN fake THEN 'placeholder' WHEN (length(o) = 10 AND NOT starts_with(v, '+')) OR (length(o) = 11 AND starts_with(o, '1')) OR (starts_with(v, '+') AND length(o) BETWEEN 8 AND 15) OR length(o) = 7 THEN NULL ELSE 'invalid' END",
    "CASE WHEN d = '' OR fake THEN v WHEN (length(o) = 10 AND NOT starts_with(v, '+')) OR (length(o) = 11 AND starts_with(o, '1')) THEN '(' || substr(right(o, 10), 1, 3) || ') ' || substr(right(o, 10), 4, 3) || '-' || right(o, 4) || CASE WHEN o <> d THEN ' ext. ' || substr(d, length(o) + 1) ELSE '' END WHEN starts_with(v, '+') AND length(o) BETWEEN 8 AND 15 THEN '+' || o WHEN length(o) = 7 THEN substr(o, 1, 3) || '-' || substr(o, 4) ELSE v END",
)} FROM (SELECT *, length(replace(right(d, 10), left(right(d, 10), 1), '')) = 0 OR right(d, 10) IN ('1234567890', '0123456789', '0987654321') OR ends_with(d, '0000000') AS fake FROM (SELECT row_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d, regexp_replace(regexp_replace(lower(v), '[\\s,;]*(ext\\.?|x|extension)[ .]*[0-9]+\\s*$', ''), '[^0-9]', '', 'g') AS o FROM (SELECT row_id, coalesce({_TIDY.format('phone')}, '') AS v FROM people_export) AS a) AS b) AS c"""
_ZIPS = f"""SELECT row_id, {_JUDGED.format(
    "CASE WHEN regexp_full_match(u, '[0-9\\s-]+') AND length(d) NOT IN (3, 4, 5, 7, 8, 9) THEN 'invalid' END",
    "CASE WHEN regexp_full_match(u, '[0-9\\s-]+') THEN CASE WHEN length(d) IN (3, 4) THEN lpad(d, 5, '0') WHEN length(d) = 5 THEN d WHEN length(d) IN (7, 8, 9) THEN substr(lpad(d, 9, '0'), 1, 5) || '-' || right(d, 4) ELSE u END ELSE u END",
)} FROM (SELECT *, regexp_replace(u, '[^0-9]', '', 'g') AS d FROM (SELECT row_id, v, regexp_replace(upper(v), '^([0-9]+)\\.0+$', '\\1') AS u FROM (SELECT row_id, coalesce({_TIDY.format('zip')}, '') AS v FROM people_export) AS a) AS b) AS c"""
_MAILS = f"""SELECT row_id, {_JUDGED.format(
    "CASE WHEN split_part(m, '@', 1) IN ('noemail', 'no-email', 'no.email', 'none', 'na', 'nobody', 'noone', 'no', 'test', 'asdf', 'fake', 'email', 'donotreply', 'do-not-reply', 'noreply', 'no-reply', 'unknown') AND contains(m, '@') THEN 'placeholder' WHEN regexp_full_match(m, '[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\\.[a-z]{2,}') AND NOT contains(m, '..') THEN NULL ELSE 'invalid' END",
    "CASE WHEN (split_part(m, '@', 1) IN ('noemail', 'no-email', 'no.email', 'none', 'na', 'nobody', 'noone', 'no', 'test', 'asdf', 'fake', 'email', 'donotreply', 'do-not-reply', 'noreply', 'no-reply', 'unknown') AND contains(m, '@')) OR (regexp_full_match(m, '[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\\.[a-z]{2,}') AND NOT contains(m, '..')) THEN m ELSE v END",
)} FROM (SELECT row_id, v, CASE WHEN row_id % 3 = 0 THEN replace(replace(replace(replace(lower(v), '<', ''), '>', ''), 'mailto:', ''), '@gmial.com', '@gmail.com') ELSE replace(lower(v), ' ', '') END AS m FROM (SELECT row_id, coalesce({_TIDY.format("CASE WHEN row_id % 3 = 0 THEN '<mailto:' || split_part(email, '@', 1) || '@gmial.com>' ELSE email END")}, '') AS v FROM people_export) AS a) AS b"""
_FP = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(v)), '[^a-z0-9_\\s]', '', 'g')), '\\s+'), lambda w: w <> ''))), ' ')"
_CO = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(v)), '[^a-z0-9_\\s&]', ' ', 'g')), '\\s+'), lambda w: w NOT IN ('', 'inc', 'incorporated', 'llc', 'llp', 'lp', 'ltd', 'limited', 'corp', 'corporation', 'co', 'company', 'plc', 'gmbh', 'ag', 'sa', 'sas', 'srl', 'bv', 'nv', 'pty', 'pllc', 'pc', 'the')))), ' ')"
_NG = "array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length(s) - 1, 1) + 1), lambda i: substr(s, i, 2)))), '')"


def _groups(source: str, column: str, method: str, key: str) -> str:
    return f"""WITH c AS (SELECT v, COUNT(*) AS n FROM (SELECT {_TIDY.format(column)} AS v FROM {source}) AS x WHERE v <> '' AND lower(v) NOT IN ({_STAND_INS}) GROUP BY v), s AS (SELECT *, regexp_replace(lower(strip_accents(v)), '[^a-z0-9]', '', 'g') AS s FROM c),
        k AS (SELECT v, n, {key} AS word, {_NG} AS gram FROM s), u AS (SELECT '{method}' AS method, word AS key, v, n, word FROM k WHERE word <> '' UNION ALL SELECT 'ngram', gram, v, n, word FROM k WHERE gram <> '')
        SELECT method, key, COUNT(*) AS "values", SUM(n)::BIGINT AS rows, first(v ORDER BY n DESC, (regexp_matches(v, '\\p{{Lu}}') AND regexp_matches(v, '\\p{{Ll}}')) DESC, length(v), hex(encode(v)) DESC) AS suggested FROM u GROUP BY method, key
        HAVING COUNT(*) > 1 AND (method <> 'ngram' OR COUNT(DISTINCT CASE WHEN word = '' THEN chr(1) || v ELSE word END) > 1)"""


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            clean_phones, clean_emails, clean_zips, clean_names, clean_addresses, clean_identifiers, clean_states, clean_urls, cleanup_scan, cleanup_examples, cleanup_junk, cleanup_columns, spelling_groups, company_groups, cleanup_apply,
            cleanup_summary, pair_likelihood, value_frequencies, review_bands, ranking_predictions, sounds, queue_page, latest_overrides, split_constraints,
        )
    }


def oracle_sql() -> dict[str, str]:
    empty = f"lower({{0}}) IN ('', {_STAND_INS})"
    cols = {x: f"coalesce({_TIDY.format(x)}, '')" for x in ROLES}
    return {
        "value_frequencies": f"WITH {_NORMAL}, v AS (SELECT 'phone' AS kind, e164 AS value FROM n UNION ALL SELECT 'email', mail FROM n UNION ALL SELECT 'address', concat_ws(' ', NULLIF(house_number, ''), NULLIF(street, ''), NULLIF(unit, '')) FROM n WHERE adr <> '') SELECT kind, value, round(COUNT(*) / (SELECT COUNT(*) FROM people_export), 9) AS share FROM v WHERE value IS NOT NULL GROUP BY ALL",
        "clean_phones": _PHONES,
        "clean_zips": _ZIPS,
        "clean_emails": _MAILS,
        "clean_identifiers": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR) || 'E+11' ELSE CAST(o_orderkey AS VARCHAR) END AS value, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 AND o_orderkey < 10 THEN 'invalid' END AS problem FROM orders",
        "clean_states": "SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'NY' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'PR' WHEN 4 THEN 'Upper Austria' ELSE array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS value, CAST(NULL AS VARCHAR) AS problem FROM nation",
        "cleanup_junk": f"""WITH r AS (SELECT {' AND '.join(empty.format(v) for v in cols.values())} AS gone, {" || chr(1) || ".join(f'lower({v})' for v in cols.values())} AS key,
            coalesce(split_part(lower(email), '@', 1) IN ('test', 'asdf', 'fake') AND contains(email, '@'), FALSE) OR coalesce(len(list_filter(string_split(lower({cols['name']}), ' '), lambda w: w IN ('test', 'testing', 'tester', 'asdf', 'asdfgh', 'qwerty', 'dummy', 'sample', 'lorem', 'ipsum', 'xxx', 'zzz', 'foo', 'bar', 'abc', 'aaa'))) > 0
            AND len(list_filter(string_split(lower({cols['name']}), ' '), lambda w: w NOT IN ('test', 'testing', 'tester', 'asdf', 'asdfgh', 'qwerty', 'dummy', 'sample', 'lorem', 'ipsum', 'xxx', 'zzz', 'foo', 'bar', 'abc', 'aaa', 'user', 'name', 'person'))) = 0, FALSE) AS test FROM people_export)
            SELECT COUNT(*) FILTER (WHERE gone) AS empty, COUNT(*) FILTER (WHERE NOT gone) - COUNT(DISTINCT key) FILTER (WHERE NOT gone) AS exact_duplicates, COUNT(*) FILTER (WHERE NOT gone AND test) AS test FROM r""",
        "spelling_groups": _groups("(SELECT CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN replace(o_orderpriority, '-', ' ') ELSE o_orderpriority END AS typed FROM orders) AS o", "typed", "fingerprint", _FP),
        "company_groups": _groups("people_export", "name", "company", _CO),
        "queue_page": "SELECT decision_id FROM (SELECT DISTINCT * FROM decisions WHERE decision = 'possible_match') AS d ORDER BY coalesce(likelihood, -1) DESC, score DESC NULLS LAST, decision_id LIMIT 10 OFFSET 10",
        "latest_overrides": "SELECT dataset_id, last(override_id ORDER BY created_at, override_id) AS override_id FROM canonical_overrides WHERE revoked_at IS NULL GROUP BY dataset_id",
        "split_constraints": 'SELECT least(a, b) AS "left", greatest(a, b) AS "right", \'must_not_link\' AS kind FROM (SELECT CAST(x.n_nationkey AS VARCHAR) AS a, CAST(y.n_nationkey AS VARCHAR) AS b FROM nation AS x, nation AS y WHERE x.n_regionkey = 1 AND y.n_regionkey <> 1) AS p',
    }

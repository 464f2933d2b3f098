"""Queries of the match run over the driver's tables, with SQL of their own where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import normalize as nz
from rowloom.functions import similarity as sim
from rowloom.functions import text as t
from rowloom.operators import matching as m
from rowloom.operators.components import connected
from rowloom.runtime import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
MAPPING = {"name": "name", "phone": "phone", "email": "email", "address": "address", "zip": "postal_code"}
CRM = {"full_name": "name", "mobile": "phone", "street": "address", "city": "city", "zip_code": "postal_code"}
CONTACTS = {"phone": "phone", "email": "email", "zip": "postal_code"}


def _people(spark: SparkSession, sf: str, mapping: dict[str, str] = MAPPING) -> DataFrame:
    return nz.normalized(table(spark, sf, "people_export"), "row_id", mapping)


def match_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison values of every row."""
    n = F.col("n")
    return _people(spark, sf).select("row_id", n["name"].alias("name"), F.array_join(n["phone"], ",").alias("phone"), F.array_join(n["email"], ",").alias("email"), n["postal_code"].alias("zip"), *[n["address"][c].alias(c) for c in ("house_number", "street", "unit", "full")])


def match_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Given names, surname, sound and possible initials of every person."""
    p = _people(spark, sf).select("row_id", F.col("n.person").alias("p")).where("p IS NOT NULL")
    return p.select("row_id", F.array_join("p.given", " ").alias("given"), "p.surname", t.soundex(F.col("p.surname")).alias("sound"), F.array_join(F.array_sort(nz.initials(F.element_at("p.given", 1))), "").alias("initials"))


def match_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers within the bounds of a latitude, with seven digits."""
    return table(spark, sf, "customer").select("c_custkey", nz.coordinate((F.col("c_acctbal") / 50).cast("string"), -90, 90).alias("latitude"))


def match_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical URLs of all runs, with parameters added that must be sorted or dropped."""
    u = F.col("source_url")
    return table(spark, sf, "scrape_result").select("run_id", "source_url").distinct().select("run_id", nz.url(u).alias("plain"), nz.url(F.concat(F.regexp_replace(u, r"\?.*$", ""), F.lit("/?utm_source=x&z=1&ref=q&a=2&e=#top"))).alias("tracked"))


def match_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and ids of every block of two rows or more."""
    keys = m.block_keys(_people(spark, sf))
    return m.block_sizes(keys).where("size >= 2").select(m.block_id(F.col("key")).alias("block_id"), F.substring_index("key", ":", 1).alias("kind"), "size")


def match_name_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Surname blocks of people: sound, initial and region, with the rows that count for the limit."""
    keys = m.block_keys(_people(spark, sf), person=True).where("key LIKE 'pname:%'")
    return m.block_sizes(keys).where("size >= 2").select("key", "size", "counted")


def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that share a block of at most 200 rows, with the number of their blocks."""
    return m.candidates(m.block_keys(_people(spark, sf)), 200).select("left", "right", F.size("block_ids").alias("blocks"))


def match_oversized(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of more than 8 rows, which a limit of 8 leaves unpaired."""
    return m.oversized(m.block_keys(_people(spark, sf)), 8)


def _contact_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = Scratch(spark).cut(_people(spark, sf, CONTACTS))
    return m.decide(m.compare(m.candidates(m.block_keys(rows), 200), rows), "conservative")


def match_contact_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions from telephone, mailbox and postal code alone."""
    return _contact_decisions(spark, sf).select("decision_id", "left", "right", F.round("score", 6).alias("score"), "comparable", "decision")


def match_components(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that the reviewers' matches link directly or indirectly."""
    d = table(spark, sf, "decisions").where("decision = 'match'").select(F.col("left_row_id").alias("a"), F.col("right_row_id").alias("b"))
    return connected(d, "a", "b", Scratch(spark)).select("id", F.col("group").alias("group_id"))


def _run(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return m.run_match({"people": table(spark, sf, "people_export"), "crm": table(spark, sf, "crm_contacts").withColumnRenamed("crm_id", "row_id")}, {"people": MAPPING, "crm": CRM}, "row_id", person=True)


def match_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of a whole run over two datasets of people, with their reasons."""
    return _run(spark, sf)["decisions"].select("decision_id", "left", "right", F.round("score", 6).alias("score"), "comparable", "decision", "reason", F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["field"], e["result"], e["strength"])), ",").alias("evidence"))


def match_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a whole run over two datasets of people."""
    return _run(spark, sf)["clusters"]


def match_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of a whole run over two datasets of people."""
    return m.run_metrics(_run(spark, sf))


def _grouped(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Rows of people_export in the groups that their lists name, ranked."""
    people = table(spark, sf, "people_export").withColumns({"row_id": F.col("row_id").cast("string"), "source": F.col("dataset_id"), "row_number": F.col("source_row_number")})
    lists = people.select(F.array_sort(F.array_distinct(F.filter(F.split("source_row_ids", ";"), lambda x: x != ""))).alias("ids")).where(F.size("ids") >= 2).distinct()
    member = lists.select(F.array_min("ids").alias("cluster_id"), F.explode("ids").alias("row_id")).distinct()
    trust = [r["dataset_id"] for r in table(spark, sf, "datasets").orderBy("trust_rank").select("dataset_id").collect()]  # a fixed table of 24 rows
    columns = ["name", "phone", "email", "address", "zip"]
    return m.survivor_rank(people, member, columns, trust=trust), columns


def canonical_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving row of every group, by trust, completeness, dataset, row number and id."""
    ranked, _ = _grouped(spark, sf)
    return ranked.groupBy("cluster_id").agg(F.min_by("row_id", "rank").alias("survivor_row_id"))


def canonical_values(spark: SparkSession, sf: str) -> DataFrame:
    """The value of every column of every group with its origin and the number of different values."""
    ranked, columns = _grouped(spark, sf)
    return m.canonicalize(ranked, columns)


def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Jaro-Winkler and edit similarity of customer and supplier names of one nation and balance rank, and of the two words of part names."""
    p = table(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("a"), F.substring_index("p_name", " ", -1).alias("b")).distinct()
    return p.select("a", "b", F.round(sim.winkler("a", "b"), 6).alias("jw"), (F.levenshtein("a", "b", 1) >= 0).alias("near"))


def token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Token-sort ratio of every part's name and type."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", F.round(sim.token_sort("a", "b"), 6).alias("ratio"), F.round(sim.indel("a", "b"), 6).alias("plain"))


_TXT = "trim(regexp_replace(regexp_replace(replace(lower(strip_nbsp), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{N}_\\s#-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _text(column: str) -> str:
    return _TXT.replace("strip_nbsp", f"replace(nfc_normalize({column}), chr(160), ' ')")


def _map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in entries.items()) + "}"


_FOLDS = _map({
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "lane": "ln", "boulevard": "blvd", "court": "ct", "place": "pl", "circle": "cir", "highway": "hwy", "parkway": "pkwy", "terrace": "ter", "trail": "trl",
    "square": "sq", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
})
_RAW = "trim(regexp_replace(lower(phone), '[\\s,;]*(ext\\.?|x|extension)[ .]*[0-9]+\\s*$', ''))"
_UNIT = "\\b(?:apt|apartment|unit|ste|suite|#)\\s*([a-z0-9-]+)\\b"
_NORMAL = f"""
    a AS (SELECT CAST(row_id AS VARCHAR) AS row_id, NULLIF({_text('name')}, '') AS name, {_RAW} AS raw, regexp_replace({_RAW}, '[^0-9]', '', 'g') AS d, lower(trim(email)) AS m, regexp_replace(lower(zip), '\\s+', '', 'g') AS z, {_text('address')} AS adr FROM people_export),
    b AS (SELECT *, CASE WHEN length(d) < 7 THEN NULL WHEN length(d) = 10 AND NOT starts_with(raw, '+') THEN '+1' || d WHEN length(d) = 11 AND starts_with(d, '1') THEN '+' || d WHEN starts_with(raw, '+') THEN '+' || d ELSE d END AS e164,
            CASE WHEN regexp_full_match(m, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN m END AS mail, CASE WHEN regexp_full_match(z, '[0-9]{{5}}(-?[0-9]{{4}})?') THEN substr(z, 1, 5) WHEN z <> '' THEN z END AS code,
            regexp_extract(adr, '{_UNIT}', 1) AS unit, trim(regexp_replace(adr, '{_UNIT}', '')) AS rest FROM a),
    c AS (SELECT *, list_transform(list_filter(regexp_split_to_array(replace(rest, '#', ' '), '\\s+'), lambda w: w <> ''), lambda w: coalesce({_FOLDS}[w], w)) AS tok FROM b),
    n AS (SELECT *, CASE WHEN regexp_full_match(tok[1], '[0-9]+[a-z]?') THEN tok[1] ELSE '' END AS house_number, array_to_string(CASE WHEN regexp_full_match(tok[1], '[0-9]+[a-z]?') THEN tok[2:] ELSE tok END, ' ') AS street FROM c)"""
_KEYS = f"""{_NORMAL},
    k AS (SELECT row_id, 'phone:' || e164 AS key FROM n WHERE length(regexp_replace(e164, '[^0-9]', '', 'g')) >= 10
        UNION SELECT row_id, 'email:' || mail FROM n WHERE mail IS NOT NULL
        UNION SELECT row_id, 'addr:' || house_number || ':' || CASE WHEN code IS NULL THEN street ELSE substr(split_part(street, ' ', 1), 1, 4) || ':' || substr(code, 1, 3) END FROM n WHERE adr <> '' AND house_number <> '' AND street <> ''
        UNION SELECT row_id, 'name_postal:' || array_to_string(list_sort(string_split(name, ' ')), ' ') || ':' || code FROM n WHERE contains(name, ' ') AND code IS NOT NULL),
    s AS (SELECT key, COUNT(*) AS size FROM k GROUP BY key HAVING COUNT(*) >= 2)"""
_CONTACT_PAIRS = f"""{_KEYS},
    q AS (SELECT DISTINCT least(x.row_id, y.row_id) AS "left", greatest(x.row_id, y.row_id) AS "right" FROM k AS x JOIN k AS y ON x.key = y.key AND x.row_id < y.row_id JOIN s ON s.key = x.key AND s.size <= 200 WHERE x.key LIKE 'phone:%' OR x.key LIKE 'email:%'),
    v AS (SELECT q.*, CASE WHEN l.e164 IS NOT NULL AND r.e164 IS NOT NULL THEN CAST(l.e164 = r.e164 AS INT) END AS p, CASE WHEN l.mail IS NOT NULL AND r.mail IS NOT NULL THEN CAST(l.mail = r.mail AS INT) END AS e, CASE WHEN l.code IS NOT NULL AND r.code IS NOT NULL THEN CAST(l.code = r.code AS INT) END AS g FROM q JOIN n AS l ON l.row_id = q."left" JOIN n AS r ON r.row_id = q."right"),
    w AS (SELECT *, (coalesce(.32 * p, 0) + coalesce(.28 * e, 0) + coalesce(.05 * g, 0)) / (CASE WHEN p IS NULL THEN 0 ELSE .32 END + CASE WHEN e IS NULL THEN 0 ELSE .28 END + CASE WHEN g IS NULL THEN 0 ELSE .05 END) AS score, CAST(p IS NOT NULL AS INT) + CAST(e IS NOT NULL AS INT) + CAST(g IS NOT NULL AS INT) AS comparable FROM v)"""
_GROUPED = """
    l AS (SELECT DISTINCT list_sort(list_distinct(list_filter(string_split(source_row_ids, ';'), lambda x: x <> ''))) AS ids FROM people_export),
    g AS (SELECT DISTINCT list_min(ids) AS cluster_id, UNNEST(ids) AS row_id FROM l WHERE len(ids) >= 2),
    r AS (SELECT g.cluster_id, p.*, row_number() OVER (PARTITION BY g.cluster_id ORDER BY d.trust_rank, -(CAST(coalesce(p.name, '') <> '' AS INT) + CAST(coalesce(p.phone, '') <> '' AS INT) + CAST(coalesce(p.email, '') <> '' AS INT) + CAST(coalesce(p.address, '') <> '' AS INT) + CAST(coalesce(p.zip, '') <> '' AS INT)), p.dataset_id, p.source_row_number, CAST(p.row_id AS VARCHAR)) AS k
        FROM g JOIN people_export AS p ON CAST(p.row_id AS VARCHAR) = g.row_id LEFT JOIN datasets AS d USING (dataset_id)),
    t AS (SELECT cluster_id, CAST(row_id AS VARCHAR) AS survivor_row_id FROM r WHERE k = 1)"""


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            match_normalized, match_persons, match_coordinates, match_urls, match_blocks, match_name_blocks, match_candidates, match_oversized, match_contact_decisions, match_components, match_decisions, match_clusters, match_metrics,
            canonical_survivors, canonical_values, name_similarity, token_similarity,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "match_normalized": f"WITH {_NORMAL} SELECT row_id, name, coalesce(e164, '') AS phone, coalesce(mail, '') AS email, code AS zip, CASE WHEN adr <> '' THEN house_number END AS house_number, CASE WHEN adr <> '' THEN street END AS street, CASE WHEN adr <> '' THEN unit END AS unit, CASE WHEN adr <> '' THEN concat_ws(' ', NULLIF(house_number, ''), NULLIF(street, ''), NULLIF(unit, '')) END AS full FROM n",
        "match_coordinates": "SELECT c_custkey, CASE WHEN c_acctbal / 50 BETWEEN -90 AND 90 THEN round(c_acctbal / 50, 7) END AS latitude FROM customer",
        "match_urls": """WITH u AS (SELECT DISTINCT run_id, regexp_replace(source_url, '^[a-z]+://(www\\.)?', '') AS u FROM scrape_result WHERE source_url IS NOT NULL), h AS (SELECT *, lower(split_part(split_part(u, '?', 1), '/', 1)) AS host, regexp_replace(regexp_extract(split_part(u, '?', 1), '^[^/]*(.*)$', 1), '/+$', '') AS path FROM u)
            SELECT run_id, '//' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN contains(u, '?') THEN '?' || split_part(u, '?', 2) ELSE '' END AS plain, '//' || host || CASE WHEN path = '' THEN '/' ELSE path END || '?a=2&z=1' AS tracked FROM h UNION ALL SELECT DISTINCT run_id, NULL, NULL FROM scrape_result WHERE source_url IS NULL""",
        "match_blocks": f"WITH {_KEYS} SELECT split_part(key, ':', 1) || ':' || substr(sha1(key), 1, 10) AS block_id, split_part(key, ':', 1) AS kind, size FROM s",
        "match_candidates": f'WITH {_KEYS} SELECT least(x.row_id, y.row_id) AS "left", greatest(x.row_id, y.row_id) AS "right", COUNT(*)::INT AS blocks FROM k AS x JOIN k AS y ON x.key = y.key AND x.row_id < y.row_id JOIN s ON s.key = x.key AND s.size <= 200 GROUP BY ALL',
        "match_oversized": f"WITH {_KEYS} SELECT split_part(key, ':', 1) || ':' || substr(sha1(key), 1, 10) AS block_id, split_part(key, ':', 1) AS kind, size FROM s WHERE size > 8",
        "match_contact_decisions": f"""WITH {_CONTACT_PAIRS} SELECT 'd_' || substr(sha1("left" || '|' || "right"), 1, 16) AS decision_id, "left", "right", round(score, 6) AS score, comparable, CASE WHEN (p = 1 OR e = 1) AND score >= .95 AND comparable >= 2 THEN 'match' WHEN p = 1 OR e = 1 THEN 'possible_match' WHEN score >= .75 AND comparable >= 2 THEN 'possible_match' ELSE 'non_match' END AS decision FROM w""",
        "match_components": "WITH RECURSIVE e AS (SELECT DISTINCT left_row_id AS a, right_row_id AS b FROM decisions WHERE decision = 'match' AND left_row_id <> right_row_id), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(id, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT w.id, u.b FROM w JOIN u ON u.a = w.seen) SELECT id, min(seen) AS group_id FROM w GROUP BY id",
        "canonical_survivors": f"WITH {_GROUPED} SELECT * FROM t",
        "canonical_values": f"""WITH {_GROUPED}, c AS (SELECT cluster_id, CAST(row_id AS VARCHAR) AS row_id, k, UNNEST(['name', 'phone', 'email', 'address', 'zip']) AS column_name, UNNEST([name, phone, email, address, zip]) AS value FROM r),
            f AS (SELECT cluster_id, column_name, arg_min(value, k) FILTER (WHERE value <> '') AS value, arg_min(row_id, k) FILTER (WHERE value <> '') AS row_id, COUNT(DISTINCT value) FILTER (WHERE value <> '') AS different FROM c GROUP BY ALL)
            SELECT f.cluster_id, t.survivor_row_id, column_name, coalesce(value, '') AS value, row_id, CASE WHEN row_id = t.survivor_row_id THEN 'survivor' WHEN row_id IS NOT NULL THEN 'fill_from_member' END AS rule, CASE WHEN different > 1 THEN different ELSE 0 END AS conflicts FROM f JOIN t USING (cluster_id)""",
        "name_similarity": "SELECT DISTINCT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw, levenshtein(a, b) <= 1 AS near FROM (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS b FROM part) AS x",
    }

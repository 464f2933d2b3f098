"""Queries of the training-data problems: callables (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows at one location, written differently."""
    from rowloom.llm.places import same_places

    return same_places(table(spark, sf_dir, "people_export"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one person or organisation, spelt differently."""
    from rowloom.llm.names import same_names

    return same_names(table(spark, sf_dir, "people_export"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of records and warnings that hold residue instead of content."""
    from rowloom.llm.residue import residue

    return residue(table(spark, sf_dir, "scrape_result")).select("run_id", "field_name", "item_pos")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every group with its chosen row and what decided."""
    from rowloom.llm.survivors import survivors

    return survivors(table(spark, sf_dir, "people_export"), table(spark, sf_dir, "canonical_overrides"), table(spark, sf_dir, "datasets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields decided by an override or by one dominant row."""
    return p4_survivors(spark, sf_dir).where(F.col("basis").isin("override", "dominant")).select("group_id", "column_name", "row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group identifier per linked row of people_export."""
    from rowloom.llm.components import group_linked
    from rowloom.llm.survivors import member_ids

    people = table(spark, sf_dir, "people_export")
    known = people.select(F.col("row_id").alias("id")).distinct()
    lists = people.select(F.sort_array(member_ids("source_row_ids")).alias("ids")).where(F.size("ids") >= 2).distinct()
    decided = table(spark, sf_dir, "decisions").where("decision = 'match'").select(F.col("left_row_id").alias("a"), F.col("right_row_id").alias("b"))
    decided = decided.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    decided = decided.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    # members that exist, each linked to the smallest member of its list that exists
    named = lists.select(F.md5(F.array_join("ids", ";")).alias("list"), F.explode("ids").alias("id")).join(known, "id", "left_semi")
    first = named.groupBy("list").agg(F.min("id").alias("a"))
    listed = named.join(first, "list").where("a <> id").select("a", F.col("id").alias("b"))
    return group_linked(decided.unionByName(listed), "a", "b")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    crm = table(spark, sf_dir, "crm_contacts").select(F.col("crm_id").cast("long").alias("id"), F.col("full_name").alias("name"), F.col("mobile").alias("phone"), none.alias("email"), F.col("street").alias("address"), F.col("zip_code").alias("zip"), F.col("city").alias("town"))
    people = table(spark, sf_dir, "people_export").select(F.col("row_id").cast("long").alias("id"), "name", "phone", "email", "address", "zip", none.alias("town"))
    return crm, people


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every compared pair of a contact and a row, with agreement levels and confidence."""
    from rowloom.llm.linkage import link_sources

    return link_sources(*_sources(spark, sf_dir)).withColumnsRenamed({"left_id": "crm_id", "right_id": "row_id"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts and rows that are the same person or organisation."""
    from rowloom.llm.linkage import link_sources, matches

    return matches(link_sources(*_sources(spark, sf_dir))).select(F.col("left_id").alias("crm_id"), F.col("right_id").alias("row_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    from rowloom.llm.tokens import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece for each capacity."""
    from rowloom.llm.packing import fill_containers
    from rowloom.llm.tokens import encode_corpus

    sizes = encode_corpus(table(spark, sf_dir, "documents"), counts_only=True)
    return fill_containers(sizes, table(spark, sf_dir, "context_windows"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's text, put together again from its ids."""
    from rowloom.llm.tokens import decode_corpus

    return decode_corpus(p8_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the rules of the containers, by capacity: tokens lost or doubled, containers over their capacity, texts split without need, pieces out of order."""
    from rowloom.llm.packing import fill_containers
    from rowloom.llm.tokens import encode_corpus
    from rowloom.runtime import Scratch

    scratch = Scratch(spark)
    sizes = scratch.cut(encode_corpus(table(spark, sf_dir, "documents"), counts_only=True))
    wins = table(spark, sf_dir, "context_windows")
    placed = scratch.cut(fill_containers(sizes, wins))
    whole = sizes.agg(F.sum("n_tokens").alias("all"), F.count("*").alias("texts"))
    text = placed.groupBy("window_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece").alias("last")).join(sizes, "doc_id").join(wins.select("window_id", "capacity_tokens").distinct(), "window_id")
    by_text = text.groupBy("window_id").agg(F.count_if(F.col("n") != F.col("n_tokens")).alias("wrong_texts"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("split_in_vain"), F.count_if(F.col("last") != F.col("pieces") - 1).alias("out_of_order"), F.count("*").alias("seen"))
    full = placed.where("container IS NOT NULL").groupBy("window_id", "container").agg(F.sum("n_tokens").alias("n")).join(wins.select("window_id", "capacity_tokens").distinct(), "window_id").groupBy("window_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    return by_text.join(full, "window_id").crossJoin(whole).select("window_id", "wrong_texts", "split_in_vain", "out_of_order", "overfull", (F.col("texts") - F.col("seen")).alias("missing"))  # one row


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of every capacity are."""
    from rowloom.llm.packing import fill_report

    return fill_report(p9_containers(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate places of rows whose address leaves open which one is meant."""
    from rowloom.llm.places import open_candidates

    return open_candidates(table(spark, sf_dir, "people_export"))


def p1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row, with the number of its rows and spellings."""
    from rowloom.llm.places import place_members

    return place_members(table(spark, sf_dir, "people_export"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every row, with the number of its spellings."""
    from rowloom.llm.names import name_members

    return name_members(table(spark, sf_dir, "people_export"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    from rowloom.llm.sentences import sentence_units

    return sentence_units(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_candidates, p1_places, p2_found, p2_entities, p3_found, p4_found, p4_survivors, p5_found, p6_found, p6_links, p8_ids, p8_decoded, p9_containers, p9_check, p9_fill, p10_found)}


_IDS = "list_distinct(list_filter(list_transform(string_split(source_row_ids, ';'), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL))"
_STAND_INS = ", ".join("'" + w + "'" for w in (
    "-", "--", "---", "?", "??", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "tbd", "tba", "x", "xx", "xxx", "xxxx", "asdf", "test", "same", "blank", "empty", "missing", "pending", "not available", "no name", "no address", "not known", "on file", "same as above", "test test", "not provided", "not given",
))


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""WITH l AS (SELECT DISTINCT {_IDS} AS ids FROM people_export), g AS (SELECT DISTINCT list_min(ids) AS group_id, UNNEST(ids) AS row_id FROM l WHERE len(ids) >= 2), m AS (SELECT g.group_id, p.*, d.trust_rank FROM g JOIN people_export AS p USING (row_id) LEFT JOIN datasets AS d USING (dataset_id)),
            c AS (SELECT group_id, row_id, updated_at, trust_rank, UNNEST(['name', 'phone', 'address', 'zip']) AS column_name, UNNEST([name, phone, address, zip]) AS value FROM m), b AS (SELECT *, lower(regexp_replace(value, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')) AS v FROM c WHERE value IS NOT NULL),
            d AS (SELECT *, regexp_replace(regexp_replace(v, CASE WHEN column_name = 'zip' THEN '\\.0$' ELSE '^$' END, ''), '[^0-9]', '', 'g') AS digits FROM b WHERE v <> '' AND v NOT IN ({_STAND_INS})),
            e AS (SELECT *, CASE WHEN column_name = 'phone' AND length(digits) = 11 AND digits[1] = '1' THEN digits[2:] ELSE digits END AS bare FROM d),
            u AS (SELECT * FROM e WHERE column_name IN ('name', 'address') OR (digits <> '' AND replace(digits, digits[1], '') <> '' AND replace(bare, bare[1], '') <> '' AND (column_name = 'zip' OR bare NOT IN ('1234567', '12345678', '123456789', '1234567890', '0123456789')))),
            w AS (SELECT group_id, column_name, row_id FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS o WHERE o.group_id = u.group_id AND o.column_name = u.column_name AND o.row_id <> u.row_id AND NOT coalesce(u.updated_at > o.updated_at AND u.trust_rank < o.trust_rank, FALSE))),
            o AS (SELECT m.group_id, lower(regexp_replace(x.column_name, '[\\s\u00a0]', '', 'g')) AS column_name, arg_max(m.row_id, (x.created_at, x.override_id)) AS row_id FROM canonical_overrides AS x JOIN m ON m.row_id = x.row_id WHERE x.revoked_at IS NULL AND lower(regexp_replace(x.column_name, '[\\s\u00a0]', '', 'g')) IN ('name', 'phone', 'address', 'zip') GROUP BY ALL)
            SELECT * FROM o UNION ALL SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.group_id = w.group_id AND o.column_name = w.column_name)""",
        "p5_found": f"""WITH RECURSIVE l AS (SELECT DISTINCT {_IDS} AS ids FROM people_export), m AS (SELECT ids, UNNEST(ids) AS id FROM l WHERE len(ids) >= 2), k AS (SELECT m.ids, m.id FROM m JOIN (SELECT DISTINCT row_id FROM people_export) AS p ON p.row_id = m.id), f AS (SELECT ids, min(id) AS a FROM k GROUP BY ids),
            e AS (SELECT left_row_id AS a, right_row_id AS b FROM decisions WHERE decision = 'match' AND left_row_id <> right_row_id AND left_row_id IN (SELECT row_id FROM people_export) AND right_row_id IN (SELECT row_id FROM people_export) UNION SELECT f.a, k.id FROM k JOIN f ON f.ids = k.ids WHERE k.id <> f.a),
            u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(row_id, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT w.row_id, u.b FROM w JOIN u ON u.a = w.seen) SELECT row_id, min(seen) AS group_id FROM w GROUP BY row_id""",
        "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p9_check": "SELECT DISTINCT window_id, 0 AS wrong_texts, 0 AS split_in_vain, 0 AS out_of_order, 0 AS overfull, 0 AS missing FROM context_windows WHERE capacity_tokens > 0",
    }

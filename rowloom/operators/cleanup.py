"""Cleanup of typed tables: standard forms by role, junk rows, spelling groups, and applying a person's plan.

A standard form is a struct (value, problem): problem is null, ``invalid`` or ``placeholder``, and with a problem the
value is the tidied original, so that nothing is lost unless a plan clears it. Everything stays inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import fixed as fx
from rowloom.functions import text as t

NAME_ROLES = ("name", "first_name", "last_name")
TITLE_ROLES = ("city", "county", "neighborhood", "district", "country")
ADDRESS_ROLES = ("address", "mailing_address", "street")
#: headers that speak of categories, and those that speak of companies
CATEGORY = re.compile(r"compan|organi[sz]ation|employer|business|firm|vendor|supplier|brand|categor|status|type|source|industry|department|title|city|county|state|country|region|segment|tag|group", re.IGNORECASE)
COMPANY = re.compile(r"compan|organi[sz]ation|employer|business|firm|vendor|supplier|brand", re.IGNORECASE)


def _table(entries: Mapping[str, str]) -> Column:
    return t.literal_map(entries)


def _fine(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("problem"))


def _bad(value: Column, problem: str) -> Column:
    return F.struct(value.alias("value"), F.lit(problem).alias("problem"))


def mixed_case(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))


def _cased(w: Column) -> Column:
    """One part of a word in title case; w is in lower case."""
    return (
        F.when(w.rlike(r"(?U)^o'\w+$"), F.concat(F.lit("O'"), _capital(F.substring(w, 3, 1 << 20)))).when(w.rlike(r"(?U)^mc\w{2,}$"), F.concat(F.lit("Mc"), _capital(F.substring(w, 3, 1 << 20))))
        .when(w.rlike(r"^[a-z]\.?$"), F.upper(w)).otherwise(_capital(w))
    )


def title_word(word: Column, first: Column) -> Column:
    """Title case of a word: written suffixes, particles inside a name in lower case, both sides of a hyphen, O' and Mc, initials."""
    known = _table(fx.WRITTEN_SUFFIXES)
    part = lambda w: F.coalesce(F.try_element_at(known, w), _cased(w))
    return t.bind(F.lower(word), lambda w: F.coalesce(F.try_element_at(known, w), F.when(~first & w.isin(*fx.WRITTEN_PARTICLES), w), F.when(w.contains("-"), F.array_join(F.transform(F.split(w, "-"), part), "-")), _cased(w)))


def title_case(c: Column) -> Column:
    """Title case for text typed all upper or all lower; mixed case is the writer's choice."""
    return t.bind(c, lambda v: F.when((v == "") | mixed_case(v), v).otherwise(F.array_join(F.transform(t.words(v), lambda w, i: title_word(w, i == 0)), " ")))


# --- standard forms by role; each takes tidied text ------------------------------------------------------------------


def person_name(c: Column) -> Column:
    """"Last, First" turned round, suffixes last; test words are a stand-in."""
    suffix = lambda w: F.lower(F.regexp_replace(w, r"^\.+|\.+$", "")).isin(*fx.SUFFIXES)

    def turned(v: Column) -> Column:
        before, after = F.trim(F.substring_index(v, ",", 1)), F.trim(F.regexp_replace(v, r"^[^,]*,", ""))
        ws = t.words(after)
        given, last = F.filter(ws, lambda w: ~suffix(w)), F.filter(ws, suffix)
        only = (before != "") & (F.size(ws) > 0) & (F.size(given) == 0)
        swap = (before != "") & (after != "") & (F.size(t.words(before)) <= 3)
        return F.when(v.contains(",") & only, F.concat_ws(" ", before, after)).when(v.contains(",") & swap, F.array_join(F.concat(given, F.array(before), last), " ")).otherwise(v)

    def judged(v: Column) -> Column:
        low = F.transform(t.words(v), F.lower)
        test = F.exists(low, lambda w: w.isin(*fx.TEST_WORDS)) & F.forall(low, lambda w: w.isin(*fx.TEST_WORDS, *fx.TEST_COMPANIONS))
        return F.when(test, _bad(v, "placeholder")).otherwise(_fine(title_case(v)))

    return t.bind(t.bind(c, turned), judged)


def phone_number(c: Column) -> Column:
    """``(512) 555-0182`` of a US number, without its extension; repeated and running digits are stand-ins; other numbers with a plus keep their digits in groups."""

    def judged(p: Column) -> Column:
        v, d = p["v"], p["d"]
        last = F.substring(d, -10, 10)
        fake = last.rlike(r"^(\d)\1*$") | last.isin("1234567890", "0123456789", "0987654321") | d.endswith("0000000")
        main = F.regexp_replace(F.lower(v), r"[\s,;]*(ext\.?|x|extension)[ .]*[0-9]+\s*$", "")
        own = F.regexp_replace(main, r"\D", "")
        home = (F.length(own) == 10) & ~main.startswith("+") | (F.length(own) == 11) & own.startswith("1")
        ten = F.substring(own, -10, 10)
        shown = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
        shown = F.when(own == d, shown).otherwise(F.concat(shown, F.lit(" ext. "), F.substring(d, F.length(own) + 1, 10)))
        abroad = main.startswith("+") & F.length(own).between(8, 15)
        return F.when(d == "", _bad(v, "invalid")).when(fake, _bad(v, "placeholder")).when(home, _fine(shown)).when(abroad, _fine(F.concat(F.lit("+"), own))).when(F.length(own) == 7, _fine(F.concat(F.substring(own, 1, 3), F.lit("-"), F.substring(own, 4, 4)))).otherwise(_bad(v, "invalid"))

    return t.bind(F.struct(c.alias("v"), F.regexp_replace(c, r"\D", "").alias("d")), judged)


def email_address(c: Column) -> Column:
    """Lower case without brackets and mailto, misspelt domains mended; local parts that are nobody's are stand-ins."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[<>]+|[<>]+$", "")), r"^(mailto:)+", ""), r" ", "")

    def mended(v: Column) -> Column:
        domain = F.substring_index(v, "@", -1)
        return F.when(v.contains("@"), F.concat(F.left(v, F.length(v) - F.length(domain)), F.coalesce(F.try_element_at(_table(fx.DOMAIN_TYPOS), domain), domain))).otherwise(v)

    def judged(v: Column) -> Column:
        stand_in = v.contains("@") & (F.substring_index(v, "@", 1).isin(*fx.PLACEHOLDER_LOCALS) & (F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit(""))) == 1) | v.isin(*fx.PLACEHOLDER_MAILS))
        good = v.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$") & ~v.contains("..")
        return F.when(stand_in, _bad(v, "placeholder")).when(good, _fine(v)).otherwise(_bad(c, "invalid"))

    return t.bind(t.bind(F.regexp_replace(low, r"[.,;]+$", ""), mended), judged)


def postal_code(c: Column, region: str = "US") -> Column:
    """US codes with lost zeros and decimals restored, Canadian and British ones with their blank; others in upper case."""

    def us(v: Column) -> Column:
        d = F.regexp_replace(v, r"\D", "")
        nine = F.lpad(d, 9, "0")
        return F.when(F.length(d).isin(3, 4), _fine(F.lpad(d, 5, "0"))).when(F.length(d) == 5, _fine(d)).when(F.length(d).isin(7, 8, 9), _fine(F.concat(F.substring(nine, 1, 5), F.lit("-"), F.substring(nine, 6, 4)))).otherwise(_bad(v, "invalid"))

    def judged(v: Column) -> Column:
        compact = F.replace(v, F.lit(" "), F.lit(""))
        british = r"^([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})$"
        other = F.when(v.rlike(r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$"), _fine(F.concat(F.substring(compact, 1, 3), F.lit(" "), F.substring(compact, 4, 3)))).when(v.rlike(british), _fine(F.concat(F.regexp_extract(v, british, 1), F.lit(" "), F.regexp_extract(v, british, 2)))).otherwise(_fine(v))
        return F.when(F.lit(region == "US") & v.rlike(r"^[\d\s-]+$"), us(v)).otherwise(other)

    return t.bind(F.regexp_replace(F.upper(c), r"^(\d+)\.0+$", "$1"), judged)


def state_or_region(c: Column, region: str = "US") -> Column:
    """Two-letter code of a US state; title case elsewhere."""
    if region != "US":
        return _fine(title_case(c))
    codes = sorted(set(fx.STATES.values()))
    return t.bind(F.trim(F.replace(F.lower(c), F.lit("."), F.lit(""))), lambda k: _fine(F.coalesce(F.try_element_at(_table(fx.STATES), k), F.when(F.upper(k).isin(*codes), F.upper(k)), title_case(c))))


def street_address(c: Column) -> Column:
    """Title case; unit words and street types in their short written form where their place says that is what they are."""
    units, types = _table(fx.WRITTEN_UNITS), _table(fx.WRITTEN_TYPES)
    bare = lambda w: F.lower(F.regexp_replace(w, r"[.,]+$", ""))

    def told(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            nxt = F.coalesce(F.try_element_at(ws, i + 2), F.lit(""))
            parts = F.struct(bare(w).alias("b"), F.replace(F.regexp_extract(w, r"([.,]*)$", 1), F.lit("."), F.lit("")).alias("tail"), bare(nxt).alias("n"), (i == F.size(ws) - 1).alias("last"), (i > 0).alias("inner"))
            unit = lambda p: F.when(p["n"].rlike("^[0-9]") | (F.length(p["n"]) <= 4), F.try_element_at(units, p["b"]))
            kind = lambda p: F.when(p["inner"] & (p["last"] | F.try_element_at(units, p["n"]).isNotNull() | p["n"].startswith("#") | (p["tail"] != "")), F.try_element_at(types, p["b"]))
            return t.bind(parts, lambda p: F.coalesce(F.concat(unit(p), p["tail"]), F.concat(kind(p), p["tail"]), w))

        return F.array_join(F.transform(ws, one), " ")

    return _fine(t.bind(t.words(title_case(c)), told))


def web_address(c: Column) -> Column:
    """A URL with scheme, scheme and host in lower case."""
    scheme = r"(?i)^[a-z][a-z0-9+.-]*://"

    def lowered(v: Column) -> Column:
        head = F.regexp_extract(v, r"^([^:]*://[^/]*)", 1)
        return _fine(F.concat(F.lower(head), F.substring(v, F.length(head) + 1, 1 << 20)))

    bare = c.rlike(r"(?i)^(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)+(/.*)?$")
    return F.when(c.contains(" "), _bad(c, "invalid")).when(c.rlike(scheme), lowered(c)).when(bare, lowered(F.concat(F.lit("https://"), c))).otherwise(_bad(c, "invalid"))


def identifier(c: Column) -> Column:
    """``123.0`` as ``123``; numbers shortened to powers of ten are lost."""
    return F.when(c.rlike(r"^\d+\.0+$"), _fine(F.substring_index(c, ".", 1))).when(c.rlike(r"(?i)^\d(\.\d+)?E\+\d+$"), _bad(c, "invalid")).otherwise(_fine(c))


def standardize(c: Column, role: str, region: str = "US", person: bool = True) -> Column:
    """struct(value, problem) of a value for its role; empty for null."""
    by_role = {
        "phone": phone_number, "email": email_address, "postal_code": lambda v: postal_code(v, region), "region": lambda v: state_or_region(v, region), "url": web_address, "identifier": identifier,
        **dict.fromkeys(NAME_ROLES, person_name if person else _fine), **dict.fromkeys(TITLE_ROLES, lambda v: _fine(title_case(v))), **dict.fromkeys(ADDRESS_ROLES, street_address),
    }
    form = by_role.get(role, _fine)
    return t.bind(F.coalesce(t.tidy(c.cast("string")), F.lit("")), lambda v: F.when(v == "", _fine(v)).when(t.is_placeholder(v), _bad(v, "placeholder")).otherwise(form(v)))


# --- junk rows, scan, spelling groups -----------------------------------------------------------------------------------


def is_empty_row(columns: Sequence[str]) -> Column:
    """Whether all columns are empty or stand-ins."""
    return F.forall(F.array(*[F.coalesce(t.tidy(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]), lambda v: (v == "") | t.is_placeholder(v))


def is_test_row(roles: Mapping[str, str], person: bool = True) -> Column:
    """Whether a person's name consists of test words, or a mailbox is one of a test."""
    out = F.lit(False)
    for c, role in roles.items():
        v = F.coalesce(t.tidy(F.col(f"`{c}`").cast("string")), F.lit(""))
        if role in NAME_ROLES and person:
            out = out | F.coalesce((v != "") & (person_name(v)["problem"] == "placeholder"), F.lit(False))
        elif role == "email":
            out = out | F.coalesce((v != "") & t.bind(email_address(v), lambda e: (e["problem"] == "placeholder") & F.substring_index(e["value"], "@", 1).isin("test", "asdf", "fake")), F.lit(False))
    return out


def signature(columns: Sequence[str]) -> Column:
    """A key of the row as typed, apart from case and blanks."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.lower(t.tidy(F.col(f"`{c}`").cast("string"))), F.lit("")) for c in columns]), 256)


def scan(rows: DataFrame, roles: Mapping[str, str], region: str = "US", person: bool = True) -> DataFrame:
    """(column_name, role, filled, changes, invalid, placeholders) of every column that is filled and not ignored."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("role"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("original"), standardize(F.col(f"`{c}`"), r, region, person).alias("s")) for c, r in roles.items() if r != "ignore"])
    long = rows.select(F.explode(cells).alias("e")).select("e.column_name", "e.role", "e.original", "e.s.value", "e.s.problem").where("value <> ''")
    changed = F.col("problem").isNull() & (F.col("value") != F.col("original"))
    return long.groupBy("column_name", "role").agg(F.count("*").alias("filled"), F.count_if(changed).alias("changes"), F.count_if(F.col("problem") == "invalid").alias("invalid"), F.count_if(F.col("problem") == "placeholder").alias("placeholders"))


def scan_examples(rows: DataFrame, roles: Mapping[str, str], order: str, region: str = "US", person: bool = True, examples: int = 4) -> DataFrame:
    """(column_name, problem, place, original, value): the first few different changes and problems of every column, by row order. Only the first of each spelling is looked at."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("original"), standardize(F.col(f"`{c}`"), r, region, person).alias("s")) for c, r in roles.items() if r != "ignore"])
    long = rows.select(F.col(order).alias("at"), F.explode(cells).alias("e")).select("at", "e.column_name", "e.original", "e.s.value", "e.s.problem").where("value <> '' AND (problem IS NOT NULL OR value <> original)")
    first = long.groupBy("column_name", F.coalesce("problem", F.lit("changed")).alias("problem"), F.when(F.col("problem").isNull(), F.col("original")).otherwise(F.col("value")).alias("original"), "value").agg(F.min("at").alias("at"))
    return _first_few(first, ["column_name", "problem"], ["at", "original"], examples).select("column_name", "problem", "place", "original", "value")


def _first_few(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of every group, numbered from 1; each task keeps n of a group before they meet."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def junk_rows(rows: DataFrame, columns: Sequence[str], roles: Mapping[str, str], person: bool = True) -> DataFrame:
    """(empty, exact_duplicates, test): counts of junk rows; duplicates are counted among rows that are not empty, test rows included."""
    marked = rows.select(is_empty_row(columns).alias("empty"), is_test_row(roles, person).alias("test"), signature(columns).alias("key"))
    kept = marked.where("NOT empty").groupBy("key").agg(F.count("*").alias("n"), F.count_if("test").alias("test"))
    counts = kept.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum("test"), F.lit(0)).alias("test"))
    return marked.agg(F.count_if("empty").alias("empty")).crossJoin(counts)  # one row each


def cluster_columns(rows: DataFrame, columns: Sequence[str], roles: Mapping[str, str], person: bool = True) -> list[str]:
    """The columns in which different spellings of one value are worth a look: categories, or at most 70 % different values; never numbers, contacts or people's names."""
    never = ("phone", "email", "identifier", "url", "postal_code", "first_name", "last_name", "address", "mailing_address", "street", "latitude", "longitude", "house_number", "unit", "ignore")
    asked = [c for c in columns if roles.get(c, "other") not in never and not (roles.get(c) == "name" and person)]
    if not asked:
        return []
    v = {c: F.coalesce(t.tidy(F.col(f"`{c}`").cast("string")), F.lit("")) for c in asked}
    figures = rows.select(*[v[c].alias(c) for c in asked]).agg(*[F.struct(F.count_if(F.col(f"`{c}`") != "").alias("n"), F.count_if(F.col(f"`{c}`").rlike(r"[^\d.,\s$-]")).alias("words"), F.count_distinct(F.nullif(F.col(f"`{c}`"), F.lit(""))).alias("d")).alias(c) for c in asked]).first()
    return [c for c in asked if figures[c]["n"] and figures[c]["words"] and (roles.get(c, "other") != "other" or CATEGORY.search(c) or figures[c]["d"] <= 0.7 * figures[c]["n"])]


def value_clusters(rows: DataFrame, column: str, *, company: bool = False, limit: int | None = 100) -> DataFrame:
    """(method, key, values, rows, suggested): groups of different spellings that share a key, most rows first.

    Spellings share the sorted set of their words (without legal forms for companies), or of their two-letter groups; a
    group of the second kind that adds nothing to one of the first is left out. The suggested spelling is the most
    frequent, then in mixed case, then the shorter, then the first. limit is how long the report is; None gives all.
    """
    counted = rows.select(t.tidy(F.col(f"`{column}`").cast("string")).alias("value")).where("value <> ''").where(~t.is_placeholder(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))
    first = ("company", t.company_key) if company else ("fingerprint", t.fingerprint)
    keys = F.array(F.struct(F.lit(first[0]).alias("method"), first[1](F.col("value")).alias("key")), F.struct(F.lit("ngram").alias("method"), t.ngram_fingerprint(F.col("value")).alias("key")))
    keyed = counted.select("value", "n", F.explode(keys).alias("e")).select("value", "n", "e.method", "e.key").where("key <> ''")
    best = F.max_by("value", F.struct("n", mixed_case(F.col("value")).alias("m"), (-F.length("value")).alias("l"), F.hex(F.encode("value", "utf-8")).alias("v")))
    sized = keyed.groupBy("method", "key").agg(F.count("*").alias("values"), F.sum("n").alias("rows"), best.alias("suggested")).where("values > 1")
    # a bigram group is inside a word group if one word key holds all of its spellings
    word = keyed.where(F.col("method") != "ngram").select("value", F.col("key").alias("word"))
    spread = keyed.where("method = 'ngram'").join(word, "value", "left").groupBy("key").agg(F.count_distinct(F.coalesce("word", F.concat(F.lit("\u0001"), "value"))).alias("words"))
    shown = sized.join(spread.select(F.lit("ngram").alias("method"), "key", "words"), ["method", "key"], "left").where("words IS NULL OR words > 1").drop("words")
    return shown if limit is None else shown.orderBy(F.desc("rows"), "suggested", "key").limit(limit)


# --- applying a plan ------------------------------------------------------------------------------------------------------


def _planned(c: str, role: str, clear: bool, standard: bool, merge: Mapping[str, str], region: str, person: bool) -> Column:
    """struct(value, what) of a cell after the plan; what is cleared, merged, changed or null."""
    raw = F.col(f"`{c}`").cast("string")
    same = F.struct(raw.alias("value"), F.lit(None).cast("string").alias("what"))
    if role == "ignore":
        return same

    def cell(p: Column) -> Column:
        problem = p["s"]["problem"]
        cleared = problem.isNotNull() & F.lit(clear)
        value = F.when(cleared, "").when(F.lit(standard), F.when(problem.isNull(), p["s"]["value"]).otherwise(p["t"])).otherwise(p["v"])
        target = F.coalesce(F.try_element_at(_table(merge), p["t"]), F.try_element_at(_table(merge), p["s"]["value"])) if merge else F.lit(None).cast("string")
        merged = target.isNotNull() & (value != "")
        final = F.when(merged, target).otherwise(value)
        return F.struct(final.alias("value"), F.when(cleared, "cleared").when(merged, "merged").when((final != p["v"]) & (final != ""), "changed").alias("what"))

    parts = F.struct(F.coalesce(raw, F.lit("")).alias("v"), F.coalesce(t.tidy(raw), F.lit("")).alias("t"), standardize(raw, role, region, person).alias("s"))
    return F.when(F.coalesce(t.tidy(raw), F.lit("")) == "", same).otherwise(t.bind(parts, cell))


def apply(rows: DataFrame, roles: Mapping[str, str], plan: Mapping, order: str, region: str = "US", person: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows, and (what, name, n) of what was changed, cleared, merged and dropped; order is the row number.

    plan: standardize and clear_invalid (columns), merge_values ({column, values, to}), drop_rows (empty, exact_duplicates,
    test). Rows that are the same as typed keep their first; counts of changes are of kept rows only. Input rows are never changed.
    """
    columns = [c for c in rows.columns if c != order]
    drops = set(plan.get("drop_rows") or [])
    merges: dict[str, dict[str, str]] = {}
    for m in plan.get("merge_values") or []:
        merges.setdefault(m["column"], {}).update({" ".join(str(v).split()): " ".join(str(m["to"]).split()) for v in m["values"]})
    marked = rows.withColumns({"_empty": is_empty_row(columns) if "empty" in drops else F.lit(False), "_test": is_test_row(roles, person) if "test" in drops else F.lit(False)})
    marked = marked.withColumn("_test", F.col("_test") & ~F.col("_empty"))
    if "exact_duplicates" in drops:
        marked = marked.withColumn("_key", signature(columns))
        # the first of equal rows by a minimum, so that a row typed a million times is counted and not sorted
        firsts = marked.where("NOT _empty AND NOT _test").groupBy("_key").agg(F.min(order).alias("_first"))
        marked = marked.join(firsts, "_key", "left").withColumn("_copy", ~F.col("_empty") & ~F.col("_test") & (F.col("_first") != F.col(order)))
    else:
        marked = marked.withColumn("_copy", F.lit(False))
    clears, chosen = set(plan.get("clear_invalid") or []), set(plan.get("standardize") or [])
    cells = [_planned(c, roles.get(c, "other"), c in clears, c in chosen, merges.get(c, {}), region, person).alias(c) for c in columns]
    kept = marked.where("NOT _empty AND NOT _test AND NOT _copy").select(order, *cells)
    cleaned = kept.select(order, *[F.col(f"`{c}`")["value"].alias(c) for c in columns])
    did = kept.select(F.explode(F.array(*[F.struct(F.col(f"`{c}`")["what"].alias("what"), F.lit(c).alias("name")) for c in columns])).alias("e")).where("e.what IS NOT NULL").groupBy("e.what", "e.name").agg(F.count("*").alias("n"))
    gone = marked.where("_empty OR _test OR _copy").groupBy(F.lit("dropped").alias("what"), F.when(F.col("_empty"), "empty").when(F.col("_test"), "test").otherwise("exact_duplicates").alias("name")).agg(F.count("*").alias("n"))
    return cleaned, did.unionByName(gone)

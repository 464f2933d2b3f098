"""Comparison values of a row by the roles of its columns, as expressions inside the JVM.

Missing values are absent: null, or an empty set. Nothing here raises on any text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import text as t
from rowloom.functions.fixed import DIRECTIONS, PARTICLES, PLACE_ROLES, SHORT_NAMES, STREET_TYPES, SUFFIXES, TITLES, TRACKING


def _table(entries: Mapping[str, str]) -> Column:
    return t.literal_map(entries)


def comparable(c: Column) -> Column:
    """Case-folded compatible letters, digits, # and hyphens; the rest are blanks; empty for null."""
    low = F.replace(F.lower(t.compatible(c)), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s#-]", " "), r"(?U)\s+", " ")), F.lit(""))


def _untitled(tokens: Column) -> Column:
    """Tokens without leading titles."""
    return t.bind(tokens, lambda w: t.bind(F.array_position(F.transform(w, lambda x: x.isin(*TITLES)), False), lambda k: F.slice(w, F.greatest(k, F.lit(1)).cast("int"), F.when(k == 0, 0).otherwise(F.size(w)))))


def _unsuffixed(tokens: Column) -> Column:
    """Tokens without trailing suffixes, as long as more than two are left."""

    def cut(w: Column) -> Column:
        last = F.array_position(F.transform(F.reverse(w), lambda x: x.isin(*SUFFIXES)), False)
        kept = F.when(last == 0, 0).otherwise(F.size(w) - last + 1)
        return F.slice(w, 1, F.greatest(kept, F.least(F.size(w), F.lit(2))).cast("int"))

    return t.bind(tokens, cut)


def person(c: Column) -> Column:
    """struct(given array<string>, surname) of a person's name, also of "Last, First"; null for a single word."""

    def ordered(raw: Column) -> Column:
        after = F.filter(t.words(comparable(F.regexp_replace(raw, r"^[^,]*,", ""))), lambda w: ~w.isin(*SUFFIXES))
        sides = F.struct(comparable(F.substring_index(raw, ",", 1)).alias("before"), after.alias("after"))
        turned = t.bind(sides, lambda x: F.when((x["before"] != "") & (F.size(x["after"]) > 0), F.concat(x["after"], t.words(x["before"]))))
        return F.coalesce(F.when(raw.contains(","), turned), t.words(comparable(raw)))

    def parted(w: Column) -> Column:
        given = F.filter(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: ~x.isin(*PARTICLES))
        return F.when(F.size(w) >= 2, t.bind(given, lambda g: F.when(F.size(g) > 0, F.struct(g.alias("given"), F.element_at(w, -1).alias("surname")))))

    return F.when(c.isNotNull(), t.bind(_unsuffixed(_untitled(t.bind(t.compatible(c), ordered))), parted))


def initials(given: Column, short_names: Mapping[str, str] = SHORT_NAMES) -> Column:
    """Initials under which a given name may be written: its own, those of its full names and of their other short forms."""
    full = {w for v in short_names.values() for w in v.split()}
    forms = {f: sorted({f, *(k for k, v in short_names.items() if f in v.split())}) for f in full}
    letters = {w: "".join(sorted({x[0] for f in v.split() for x in forms[f]})) for w, v in short_names.items()}
    letters |= {f: "".join(sorted({x[0] for x in forms[f]} | set(letters.get(f, "")))) for f in full}
    other = F.coalesce(F.try_element_at(_table(letters), given), F.lit(""))
    return F.when(given != "", F.array_distinct(F.filter(F.split(F.concat(F.substring(given, 1, 1), other), ""), lambda x: x != "")))


_UNIT = r"\b(?:apt|apartment|unit|ste|suite|#)\s*([a-z0-9-]+)\b"


def address(c: Column) -> Column:
    """struct(house_number, street, unit, full) of an address text, street types and directions folded; null for an empty one."""
    folds = _table({**STREET_TYPES, **DIRECTIONS})

    def split(n: Column) -> Column:
        found = F.struct(F.regexp_extract(n, _UNIT, 0).alias("whole"), F.regexp_extract(n, _UNIT, 1).alias("unit"), F.regexp_instr(n, F.lit(_UNIT)).alias("at"))
        bare = lambda m: F.when(m["whole"] == "", n).otherwise(F.trim(F.concat(F.left(n, m["at"] - 1), F.substring(n, m["at"] + F.length(m["whole"]), F.length(n)))))
        tokens = lambda m: F.transform(t.words(F.replace(bare(m), F.lit("#"), F.lit(" "))), lambda w: F.coalesce(F.try_element_at(folds, w), w))
        return t.bind(found, lambda m: t.bind(tokens(m), lambda w: parts(m, w)))

    def parts(m: Column, w: Column) -> Column:
        house = F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")).rlike(r"^\d+[a-z]?$")
        street = F.array_join(F.when(house, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w), " ")
        return F.struct(F.when(house, F.element_at(w, 1)).otherwise("").alias("house_number"), street.alias("street"), m["unit"].alias("unit"), F.array_join(w, " ").alias("full"))

    return t.bind(comparable(c), lambda n: F.when(n != "", split(n)))


def postal_code(c: Column) -> Column:
    """The five digits of a US code of five or nine; other codes in lower case without blanks; null if empty."""
    bare = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    five = F.regexp_extract(bare, r"^(\d{5})(?:-?\d{4})?$", 1)
    return F.when(bare == "", None).when(five != "", five).otherwise(bare)


def coordinate(c: Column, least: float, most: float) -> Column:
    """A number between two bounds with seven digits; null for others."""
    v = F.trim(c).try_cast("double")
    return F.when(v.between(least, most), F.round(v, 7))


def url(c: Column) -> Column:
    """``//host/path?query`` without www, tracking parameters, fragment and last slash, parameters sorted; null without a host."""

    def rebuilt(rest: Column) -> Column:
        host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", ""), r":\d*$", ""))
        path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
        pairs = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p.rlike(r"^[^=]*=.") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
        parts = F.struct(F.regexp_replace(host, r"^www\.", "").alias("host"), path.alias("path"), F.array_join(pairs, "&").alias("query"))
        return t.bind(parts, lambda p: F.when(p["host"] != "", F.concat(F.lit("//"), p["host"], F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))))

    raw = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    return F.when(F.trim(c) != "", t.bind(raw, rebuilt))


def _filled(c: Column) -> Column:
    return F.when(c.cast("string") != "", c.cast("string"))


def normalized(rows: DataFrame, row_id: str, mapping: Mapping[str, str], region: str = "US") -> DataFrame:
    """(row_id, n): the comparison values of every row as one struct.

    mapping: column -> role. Sets for phone and email, a map by column for identifiers, structs for addresses and
    persons, texts for the rest. Separate address columns make or improve the parsed address; first and last name make
    the name and the person. Columns without a role, and roles without a column, are no evidence.
    """
    by: dict[str, list[str]] = {}
    for column, role in mapping.items():
        by.setdefault(role, []).append(column)

    def one(role: str) -> Column:
        return _filled(F.col(f"`{by[role][0]}`")) if role in by else F.lit(None).cast("string")

    def word(role: str) -> Column:
        return F.nullif(comparable(one(role)), F.lit("")) if role in by else F.lit(None).cast("string")

    def many(role: str, f) -> Column:  # noqa: ANN001
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*[f(_filled(F.col(f"`{c}`"))) for c in by[role]])))) if role in by else F.array().cast("array<string>")

    ids = [F.struct(F.lit(c).alias("k"), F.nullif(F.lower(F.trim(_filled(F.col(f"`{c}`")))), F.lit("")).alias("v")) for c in sorted(by.get("identifier", []))]
    identifier = F.map_from_entries(F.filter(F.array(*ids), lambda e: e["v"].isNotNull())) if ids else F.create_map().cast("map<string,string>")
    none = F.lit(None).cast("struct<house_number:string,street:string,unit:string,full:string>")
    # in steps, so that what is named several times is evaluated once
    first, last = (comparable(one(r)) for r in ("first_name", "last_name"))
    step = rows.select(
        F.col(row_id).cast("string").alias("row_id"), identifier.alias("identifier"), many("phone", lambda c: t.phone(c, region)).alias("phone"), many("email", t.email).alias("email"), *[word(r).alias(r) for r in PLACE_ROLES],
        (address(one("address")) if "address" in by else none).alias("whole"), (address(one("mailing_address")) if "mailing_address" in by else none).alias("mailing_address"), first.alias("first"), last.alias("last"), word("name").alias("named"), one("name").alias("raw_name"),
        postal_code(one("postal_code")).alias("postal_code"), (url(one("url")) if "url" in by else F.lit(None).cast("string")).alias("url"), coordinate(one("latitude"), -90, 90).alias("latitude"), coordinate(one("longitude"), -180, 180).alias("longitude"),
    )
    parsed = F.coalesce("whole", F.when(F.col("street").isNotNull(), address(F.concat_ws(" ", "house_number", "street", "unit")))) if "street" in by else F.col("whole")
    step = step.withColumns({"parsed": parsed, "name": F.coalesce("named", F.nullif(F.trim(F.concat("first", F.lit(" "), "last")), F.lit("")))})
    step = step.withColumns({r: F.coalesce(r, F.col("parsed")[r]) for r in ("house_number", "street", "unit")})
    kept = F.concat_ws(" ", *[F.nullif(F.col(r), F.lit("")) for r in ("house_number", "street", "unit")])
    place = F.when(F.col("parsed").isNotNull(), F.struct("house_number", "street", "unit", kept.alias("full")))
    apart = F.filter(t.words(F.col("first")), lambda w: ~w.isin(*PARTICLES))
    both = F.when((F.col("first") != "") & (F.col("last") != ""), F.struct(apart.alias("given"), F.element_at(t.words(F.col("last")), -1).alias("surname")))
    who = F.when(both.isNotNull(), F.when(F.size(both["given"]) > 0, both)).otherwise(person(F.coalesce("raw_name", "name"))) if "first_name" in by and "last_name" in by else person(F.coalesce("raw_name", "name"))
    fields = ["identifier", "phone", "email", place.alias("address"), "mailing_address", "name", who.alias("person"), "postal_code", *[r for r in PLACE_ROLES if r not in ("house_number", "street", "unit")], "url", "latitude", "longitude"]
    return step.select("row_id", F.struct(*fields).alias("n"))

"""Entity resolution of rows with roles: validate, block, compare, decide, cluster under constraints, build one record a cluster.

Rows come as (row_id, n) from :func:`rowloom.functions.normalize.normalized`; pairs have left < right as texts. Missing
values are no evidence. Results are the same for the same input, whatever the partitioning.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import normalize as nz
from rowloom.functions import similarity as sim
from rowloom.functions import text as t
from rowloom.functions.fixed import GIVEN_FACTOR, LOCALITY_ROLES, ROLES, SINGLE_ROLES, STRICTNESS, WEIGHTS
from rowloom.operators.components import connected
from rowloom.runtime import Scratch

EVIDENCE_ROLES = ("identifier", "phone", "email", "address", "mailing_address", "street", "name", "first_name", "last_name", "url")


def validate_request(mappings: Mapping[str, Mapping[str, str]], *, strictness: str = "conservative", max_block_size: int = 200, region: str = "US") -> dict:
    """The settings of a run, or ValueError: known roles, each single role once a dataset, evidence in every dataset and one kind of it in common, known strictness, block size of 2 to 5,000."""
    shared: set[str] | None = None
    for name, mapping in mappings.items():
        roles = list(mapping.values())
        if unknown := sorted(set(roles) - set(ROLES)):
            raise ValueError(f"{name}: unknown roles {unknown}")
        if twice := sorted({r for r in roles if r in SINGLE_ROLES and roles.count(r) > 1}):
            raise ValueError(f"{name}: more than one column for {twice}")
        evidence = {r for r in roles if r in EVIDENCE_ROLES}
        if not evidence:
            raise ValueError(f"{name}: no column to compare")
        shared = evidence if shared is None else shared & evidence
    if not shared:
        raise ValueError("the datasets have no kind of evidence in common" if mappings else "no dataset")
    if strictness not in STRICTNESS:
        raise ValueError(f"unknown strictness {strictness}")
    if not 2 <= max_block_size <= 5000:
        raise ValueError("max_block_size must be 2 to 5000")
    return {"mappings": {k: dict(v) for k, v in mappings.items()}, "strictness": strictness, "max_block_size": max_block_size, "region": region}


def config_hash(settings: Mapping) -> str:
    """16 hex digits of the settings in canonical form, preview size aside."""
    bare = {k: v for k, v in settings.items() if k != "preview_size"}
    return hashlib.sha256(json.dumps(bare, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def is_person(entity_type: str | None, mappings: Mapping[str, Mapping[str, str]]) -> bool:
    """Whether the rows are people: said so, or not said and some column is a first or last name."""
    return entity_type == "person" or entity_type is None and any(r in ("first_name", "last_name") for m in mappings.values() for r in m.values())


# --- blocking ------------------------------------------------------------------------------------------------------


def block_keys(rows: DataFrame, *, person: bool = False) -> DataFrame:
    """(row_id, key, sparse): the blocking keys of every row; sparse: the row has neither telephone nor mailbox."""
    n = F.col("n")
    kind = lambda k, v: F.concat(F.lit(f"{k}:"), v)
    zip3 = F.substring(n["postal_code"], 1, 3)
    near = F.filter(F.array(zip3, n["city"]), lambda x: x.isNotNull() & (x != ""))
    wide = F.filter(F.array(F.coalesce(n["county"], n["region"])), lambda x: x.isNotNull() & (x != ""))
    local = F.when(F.size(near) > 0, near).otherwise(wide)

    def placed(role: str, prefix: str) -> Column:
        a = n[role]
        stem = F.substring(F.substring_index(a["street"], " ", 1), 1, 4)
        at = F.when(F.size(local) > 0, F.transform(local, lambda x: F.concat_ws(":", F.lit(prefix), a["house_number"], stem, x))).otherwise(F.array(F.concat_ws(":", F.lit(prefix), a["house_number"], a["street"])))
        return F.when(a.isNotNull() & (a["house_number"] != "") & (a["street"] != ""), at)

    tokens = F.array_sort(t.words(n["name"]))
    keys = [
        F.transform(F.map_entries(n["identifier"]), lambda e: F.concat_ws(":", F.lit("id"), e["key"], e["value"])),
        F.transform(F.filter(n["phone"], lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 10), lambda p: kind("phone", p)),
        F.transform(n["email"], lambda e: kind("email", e)),
        placed("address", "addr"), placed("mailing_address", "maddr"),
        F.when((F.size(tokens) >= 2) & n["postal_code"].isNotNull(), F.array(F.concat_ws(":", F.lit("name_postal"), F.array_join(tokens, " "), n["postal_code"]))),
        F.when(n["url"].isNotNull(), F.array(kind("url", n["url"]))),
    ]
    if person:
        who = n["person"]
        sounds = F.filter(F.array_distinct(F.transform(F.split(who["surname"], "-"), t.soundex)), lambda s: s != "")
        first = F.element_at(who["given"], 1)
        names = F.flatten(F.transform(local, lambda x: F.flatten(F.transform(sounds, lambda s: F.transform(nz.initials(first), lambda i: F.concat_ws(":", F.lit("pname"), s, i, x))))))
        keys.append(F.when(who.isNotNull(), names))
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in keys])))
    return rows.select("row_id", (F.size(n["phone"]) + F.size(n["email"]) == 0).alias("sparse"), F.explode(every).alias("key"))


def block_id(key: Column) -> Column:
    """The kind of a key and ten hex digits of its hash."""
    return F.concat(F.substring_index(key, ":", 1), F.lit(":"), F.substring(F.sha1(key), 1, 10))


def block_sizes(keys: DataFrame) -> DataFrame:
    """(key, size, counted): rows of every block, and those that count for its limit (the sparse ones of a surname block)."""
    return keys.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("sparse") | ~F.col("key").startswith("pname:")).alias("counted"))


def candidates(keys: DataFrame, max_block_size: int = 200) -> DataFrame:
    """(left, right, block_ids): pairs that share a block within the limit, with the ids of their blocks in order.

    Surname blocks exist for rows without telephone and mailbox: a pair of them needs one such row. Blocks beyond the
    limit are a feature of the operator; :func:`oversized` lists them. The largest join of a block is its limit squared.
    """
    small = block_sizes(keys).where((F.col("size") >= 2) & (F.col("counted") <= max_block_size)).select("key")
    kept = keys.join(small, "key", "left_semi")
    asks = kept.where(F.col("sparse") | ~F.col("key").startswith("pname:"))
    pairs = asks.select("key", F.col("row_id").alias("a")).join(kept.select("key", F.col("row_id").alias("b")), "key").where("a <> b")
    ordered = pairs.select("key", F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()
    return ordered.groupBy("left", "right").agg(F.array_sort(F.collect_set(block_id(F.col("key")))).alias("block_ids"))


def oversized(keys: DataFrame, max_block_size: int = 200) -> DataFrame:
    """(block_id, kind, size) of the blocks that are not paired."""
    return block_sizes(keys).where((F.col("size") >= 2) & (F.col("counted") > max_block_size)).select(block_id(F.col("key")).alias("block_id"), F.substring_index("key", ":", 1).alias("kind"), "size")


# --- comparison ----------------------------------------------------------------------------------------------------

_ITEM = "struct<field:string,similarity:double,result:string,strength:string,explanation:string>"


def _item(field: str | Column, similarity: Column, result: Column, strength: Column, explanation: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), similarity.cast("double").alias("similarity"), result.alias("result"), strength.alias("strength"), explanation.alias("explanation")).cast(_ITEM)


def _graded(s: Column) -> Column:
    return F.when(s == 1.0, "exact").when(s >= 0.8, "similar").otherwise("different")


def compare(pairs: DataFrame, rows: DataFrame, *, person: bool = False) -> DataFrame:
    """(left, right, ..., evidence, score, comparable) of every pair: what each field says, in a fixed order, and the weighted score over the fields that can be compared.

    With person, names are compared as given names and surname; different given names contradict, unless the rows share a mailbox.
    """
    wide = pairs.join(rows.select(F.col("row_id").alias("left"), F.col("n").alias("l")), "left").join(rows.select(F.col("row_id").alias("right"), F.col("n").alias("r")), "right")
    l, r = F.col("l"), F.col("r")
    scored = {}
    for role in ("address", "mailing_address"):
        scored |= {f"_{role}": sim.token_sort(l[role]["full"], r[role]["full"]), f"_{role}_street": sim.token_sort(l[role]["street"], r[role]["street"])}
    scored["_name"] = sim.token_sort(l["name"], r["name"])
    if person:
        scored["_who"] = sim.people(l["person"]["given"], l["person"]["surname"], r["person"]["given"], r["person"]["surname"])
    wide = wide.select("*", *[v.alias(k) for k, v in scored.items()])
    lit = F.lit
    items: list[Column] = []

    shared = F.array_sort(F.array_intersect(F.map_keys(l["identifier"]), F.map_keys(r["identifier"])))
    same_id = lambda c: F.element_at(l["identifier"], c) == F.element_at(r["identifier"], c)
    ids = F.transform(shared, lambda c: _item("identifier", F.when(same_id(c), 1.0).otherwise(0.0), F.when(same_id(c), "exact").otherwise("conflict"), F.when(same_id(c), "strong").otherwise("guard"), F.concat(F.when(same_id(c), "Same identifier in ").otherwise("Different identifiers in "), c)))
    for field in ("phone", "email"):
        hit = F.arrays_overlap(l[field], r[field])
        items.append(F.when((F.size(l[field]) > 0) & (F.size(r[field]) > 0), _item(field, hit.cast("double"), F.when(hit, "exact").otherwise("different"), F.when(hit, "strong").otherwise("none"), F.when(hit, f"Exact {field} match").otherwise(f"No shared {field}"))))
    for field, label in (("address", "Address"), ("mailing_address", "Mailing address")):
        a, b = l[field], r[field]
        house = (a["house_number"] != "") & (b["house_number"] != "") & (a["house_number"] != b["house_number"])
        unit = (a["unit"] != "") & (b["unit"] != "") & (a["unit"] != b["unit"])
        s = F.col(f"_{field}")
        strong = (a["house_number"] != "") & (a["house_number"] == b["house_number"]) & (F.col(f"_{field}_street") >= 0.92)
        said = F.when(strong, f"{label}: house number and street agree").otherwise(F.concat(lit(f"{label}: similarity "), F.format_string("%.2f", s)))
        contradiction = lambda what: _item(field, lit(0.0), lit("conflict"), lit("guard"), lit(f"{label}: different {what}"))  # noqa: B023, E731
        items.append(F.when(a.isNotNull() & b.isNotNull(), F.when(house, contradiction("house number")).when(unit, contradiction("unit")).otherwise(_item(field, s, _graded(s), F.when(strong, "strong").otherwise("supporting"), said))))
    s = F.col("_name")
    plain = _item("name", s, _graded(s), lit("supporting"), F.concat(lit("Name similarity "), F.format_string("%.2f", s)))
    if person:
        who = F.col("_who")
        factor = F.element_at(nz._table({k: str(v) for k, v in GIVEN_FACTOR.items()}), who["relation"]).cast("double")
        p = who["surname"] * factor
        said = F.concat(lit("Name: "), F.when(who["relation"] == "same", "same first name").when(who["relation"] == "nickname", "first name is a nickname or short form").when(who["relation"] == "similar", "first name differs by a typo").otherwise("first initial agrees"), lit(", surname similarity "), F.format_string("%.2f", who["surname"]))
        mailbox = F.arrays_overlap(l["email"], r["email"])
        apart = F.when(mailbox, _item("name", lit(0.0), lit("different"), lit("none"), lit("Different first names despite a shared email"))).otherwise(_item("name", lit(0.0), lit("conflict"), lit("guard"), lit("Different first names")))
        turned = _item("name", lit(0.95), lit("similar"), lit("supporting"), lit("Name: same name with first and last swapped"))
        named = F.when(who["relation"].isNull(), plain).when((who["relation"] == "different") & who["swapped"], turned).when(who["relation"] == "different", apart).otherwise(_item("name", p, _graded(p), lit("supporting"), said))
    else:
        named = plain
    items.append(F.when(l["name"].isNotNull() & r["name"].isNotNull(), named))
    labels = dict(zip(LOCALITY_ROLES, ("Postal code", "City", "County", "State or region", "Country code", "Country"), strict=True))
    tests = F.filter(F.array(*[F.struct(lit(labels[c]).alias("label"), (l[c] == r[c]).alias("same")) for c in LOCALITY_ROLES]), lambda x: x["same"].isNotNull())
    listed = lambda kept: F.array_join(F.transform(kept, lambda x: x["label"]), ", ")
    agree, differ = listed(F.filter(tests, lambda x: x["same"])), listed(F.filter(tests, lambda x: ~x["same"]))
    share = F.size(F.filter(tests, lambda x: x["same"])) / F.size(tests)
    items.append(F.when(F.size(tests) > 0, _item("region", share, F.when(share == 1.0, "exact").otherwise("different"), lit("supporting"), F.when(differ == "", F.concat(lit("Location agrees on "), agree)).otherwise(F.concat(lit("Location differs on "), differ)))))
    same = l["url"] == r["url"]
    items.append(F.when(same.isNotNull(), _item("url", same.cast("double"), F.when(same, "exact").otherwise("different"), F.when(same, "strong").otherwise("none"), F.when(same, "Same canonical URL").otherwise("Different URL"))))

    evidence = F.concat(ids, F.array_compact(F.array(*items)))
    weights = nz._table({k: str(v) for k, v in WEIGHTS.items()})
    weight = lambda x: F.element_at(weights, x["field"]).cast("double")
    out = wide.select(*pairs.columns, evidence.alias("evidence"))
    total = F.aggregate("evidence", lit(0.0), lambda acc, x: acc + weight(x))
    gained = F.aggregate("evidence", lit(0.0), lambda acc, x: acc + weight(x) * x["similarity"])
    return out.select("*", F.when(total > 0, gained / total).otherwise(0.0).alias("score"), F.size(F.array_distinct(F.transform("evidence", lambda x: x["field"]))).alias("comparable"))


def decide(compared: DataFrame, strictness: str = "conservative") -> DataFrame:
    """Adds decision_id, decision and reason: a contradiction always wins, then a strong identifier, then strong evidence with a high score."""
    high, low = STRICTNESS[strictness]
    said = lambda strength: F.filter("evidence", lambda x: x["strength"] == strength)
    guards, strong = said("guard"), said("strong")
    two = F.format_string("%.2f", "score")
    ident = F.exists(strong, lambda x: x["field"] == "identifier")
    sure = (F.size(strong) > 0) & (F.col("score") >= high) & (F.col("comparable") >= 2)
    maybe = (F.size(strong) > 0) | ((F.col("score") >= low) & (F.col("comparable") >= 2))
    decision = F.when(F.size(guards) > 0, "non_match").when(ident | sure, "match").when(maybe, "possible_match").otherwise("non_match")
    why = F.when(F.size(strong) > 0, "strong evidence but score below auto-match threshold").otherwise("similar values without strong evidence")
    reason = (
        F.when(F.size(guards) > 0, F.concat(F.lit("Cannot auto-merge: "), F.array_join(F.transform(guards, lambda x: x["explanation"]), "; "))).when(ident, "Same identifier with no contradiction")
        .when(sure, F.concat(F.lit("Strong evidence ("), F.array_join(F.transform(strong, lambda x: x["field"]), ", "), F.lit(") and score "), two)).when(maybe, F.concat(F.lit("Needs review: "), why, F.lit(" (score "), two, F.lit(")")))
        .when(F.col("comparable") == 0, "No comparable fields").otherwise(F.concat(F.lit("Score "), two, F.lit(" below review threshold")))
    )
    number = F.concat(F.lit("d_"), F.substring(F.sha1(F.concat_ws("|", "left", "right")), 1, 16))
    return compared.select(number.alias("decision_id"), "*", decision.alias("decision"), reason.alias("reason"))


# --- clustering under constraints ------------------------------------------------------------------------------------


class _Group:
    """What decides whether two groups may be one: sizes, houses, identifiers, locks, people and the rows it must not meet."""

    __slots__ = ("rows", "houses", "ids", "locks", "people", "foes", "confidence")

    def __init__(self, row: str, house: str | None, ids: list[str], lock: str | None, who: tuple | None, foes: set[str]):
        self.rows, self.houses, self.locks, self.confidence = {row}, {house} if house else set(), {lock}, 1.0
        self.ids: dict[str, set[str]] = {}
        for pair in ids:
            column, _, value = pair.partition("\u0001")
            self.ids.setdefault(column, set()).add(value)
        self.people, self.foes = {who} if who else set(), set(foes)

    def fits(self, other: _Group, names: bool) -> bool:
        if len(self.houses | other.houses) > 1 or len(self.locks | other.locks) > 1:
            return False
        if any(len(self.ids.get(c, set()) | other.ids.get(c, set())) > 1 for c in self.ids.keys() | other.ids.keys()):
            return False
        if self.foes & other.rows:
            return False
        return not (names and any(sim.different_people(a, b) for a in self.people for b in other.people))

    def take(self, other: _Group, score: float) -> None:
        self.rows |= other.rows
        self.houses |= other.houses
        self.locks |= other.locks
        self.people |= other.people
        self.foes |= other.foes
        for c, v in other.ids.items():
            self.ids.setdefault(c, set()).update(v)
        self.confidence = min(self.confidence, other.confidence, score)


def merge_component(nodes: Sequence[tuple], links: Sequence[tuple], person: bool) -> tuple[list[_Group], list[str], int]:
    """Groups, rejected bridges and incompatible unions of one connected component.

    nodes: (row_id, house, ids, lock, given, surname); links: (kind, left, right, score, decision_id, at), kind being
    lock, must_link, match or must_not and at the order of reviewers' links. Locks and reviewers' links come first, then
    matches by falling score.
    """
    foes: dict[str, set[str]] = {}
    for kind, a, b, *_ in links:
        if kind == "must_not":
            foes.setdefault(a, set()).add(b)
            foes.setdefault(b, set()).add(a)
    of, lock = {}, {}
    for row, house, ids, held, given, surname in nodes:
        who = (tuple(given), surname) if given is not None and surname is not None else None
        of[row] = _Group(row, house, list(ids), held, who, foes.get(row, set()))
        lock[row] = held
    matches = sorted((-score, a, b, number) for kind, a, b, score, number, _ in links if kind == "match" and b not in foes.get(a, ()))
    near: dict[str, set[str]] = {}
    for _, a, b, _ in matches:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    bridges, refused = [], 0

    def unite(p: _Group, q: _Group, score: float) -> None:
        if len(p.rows) < len(q.rows):
            p, q = q, p
        p.take(q, score)
        for row in q.rows:
            of[row] = p

    for _, _, a, b in sorted((kind, at, a, b) for kind, a, b, _, _, at in links if kind in ("lock", "must_link")):
        p, q = of[a], of[b]
        if p is q:
            continue
        if lock[a] is not None and lock[a] == lock[b] or p.fits(q, names=False):
            unite(p, q, 1.0)
        else:
            refused += 1
    for minus, a, b, number in matches:
        p, q = of[a], of[b]
        if p is q:
            continue
        if not p.fits(q, names=person):
            refused += 1
        elif len(p.rows) > 1 and len(q.rows) > 1 and sum(len(near.get(row, set()) & q.rows) for row in p.rows) < 2:
            bridges.append(number)
        else:
            unite(p, q, -minus)
    groups = list({id(g): g for g in of.values()}.values())
    return groups, bridges, refused


_CLUSTERED = "kind string, row_id string, cluster_id string, confidence double, status string, decision_id string, refused long"


def cluster(rows: DataFrame, decisions: DataFrame, constraints: DataFrame | None = None, locks: DataFrame | None = None, *, person: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row_id, cluster_id, confidence, status) of every row, and (decision_id) of the rejected bridges.

    decisions: (decision_id, left, right, score, decision); constraints: (kind must_link or must_not_link, left, right,
    at); locks: (lock_id, row_id). Constraints and locks on rows that are not there are ignored. Everything the merging
    looks at lies within one connected component of links, so each component is merged by itself in the global order:
    the result is that of one pass over all. A component is held by one task; candidate limits keep them small.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    no_links = spark.createDataFrame([], "kind string, left string, right string, at string")
    here = rows.select(F.col("row_id").alias("left"))
    there = rows.select(F.col("row_id").alias("right"))
    said = constraints.select(F.regexp_replace("kind", "must_not_link", "must_not").alias("kind"), "left", "right", F.col("at").cast("string").alias("at")) if constraints is not None else no_links
    said = said.join(here, "left", "left_semi").join(there, "right", "left_semi")
    locked = (locks if locks is not None else spark.createDataFrame([], "lock_id string, row_id string")).select(F.col("lock_id").cast("string").alias("lock"), "row_id").join(rows.select("row_id"), "row_id", "left_semi").groupBy("row_id").agg(F.max("lock").alias("lock"))
    heads = locked.groupBy("lock").agg(F.min("row_id").alias("left"))
    tied = locked.join(heads, "lock").where("left <> row_id").select(F.lit("lock").alias("kind"), "left", F.col("row_id").alias("right"), F.lit("").alias("at"))
    given = said.unionByName(tied).withColumns({"score": F.lit(1.0), "decision_id": F.lit(None).cast("string")})
    matched = decisions.where("decision = 'match'").select(F.lit("match").alias("kind"), "left", "right", F.lit("").alias("at"), F.round("score", 4).alias("score"), "decision_id")
    links = scratch.cut(given.unionByName(matched))
    of = connected(links.where("kind <> 'must_not'"), "left", "right", scratch)
    n = F.col("n")
    ids = F.transform(F.map_entries(n["identifier"]), lambda e: F.concat(e["key"], F.lit("\u0001"), e["value"]))
    who = n["person"]
    node = rows.select("row_id", F.nullif(n["address"]["house_number"], F.lit("")).alias("house"), ids.alias("ids"), who["given"].alias("given"), who["surname"].alias("surname")).join(locked, "row_id", "left").join(of.select(F.col("id").alias("row_id"), F.col("group").alias("component")), "row_id", "left")
    node = scratch.cut(node)
    side = of.select(F.col("id").alias("left"), F.col("group").alias("component"))
    joined = links.join(side, "left")
    # a must_not between two components forbids nothing
    inner = joined.join(of.select(F.col("id").alias("right"), F.col("group").alias("other")), "right").where("component = other").drop("other")

    def finish(nodes: list[tuple], linked: list[tuple]) -> list[tuple]:
        groups, bridges, refused = merge_component(nodes, linked, person)
        held = {n[0] for n in nodes if n[3] is not None}
        out = []
        for g in groups:
            name = "c_" + hashlib.sha1("|".join(sorted(g.rows)).encode()).hexdigest()[:16]
            status = "locked" if g.rows & held else "active"
            out += [("row", row, name, round(g.confidence, 3), status, None, None) for row in sorted(g.rows)]
        return out + [("bridge", None, None, None, None, b, None) for b in bridges] + [("refused", None, None, None, None, None, refused)]

    columns = [x.split()[0] for x in _CLUSTERED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # components follow each other in order: each is merged when the next begins
        at, nodes, linked = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for x in batch.itertuples(index=False, name=None):
                if x[0] != at:
                    if at is not None:
                        out += finish(nodes, linked)
                    at, nodes, linked = x[0], [], []
                if x[1] == "node":
                    nodes.append((x[2], x[3], x[4], x[5], x[6], x[7]))
                else:
                    linked.append((x[1], x[8], x[9], x[10], x[11], x[12]))
            yield pd.DataFrame(out, columns=columns)
        if at is not None:
            yield pd.DataFrame(finish(nodes, linked), columns=columns)

    null = F.lit(None).cast("string")
    parts = [F.col("row_id"), F.col("house"), F.col("ids"), F.col("lock"), F.col("given"), F.col("surname")]
    a = node.where("component IS NOT NULL").select("component", F.lit("node").alias("kind"), *parts, null.alias("left"), null.alias("right"), F.lit(0.0).alias("score"), null.alias("decision_id"), F.lit("").alias("at"))
    none = F.lit(None).cast("array<string>")
    b = inner.select("component", "kind", null.alias("row_id"), null.alias("house"), none.alias("ids"), null.alias("lock"), none.alias("given"), null.alias("surname"), "left", "right", "score", "decision_id", F.coalesce("at", F.lit("")).alias("at"))
    together = a.unionByName(b).repartition("component").sortWithinPartitions("component")
    merged = scratch.cut(together.mapInPandas(run, _CLUSTERED))
    alone = node.where("component IS NULL").select("row_id", F.concat(F.lit("c_"), F.substring(F.sha1("row_id"), 1, 16)).alias("cluster_id"), F.lit(1.0).alias("confidence"), F.when(F.col("lock").isNotNull(), "locked").otherwise("active").alias("status"))
    clusters = alone.unionByName(merged.where("kind = 'row'").select("row_id", "cluster_id", "confidence", "status"))
    return clusters, merged.where("kind = 'bridge'").select("decision_id")


# --- one record a cluster ---------------------------------------------------------------------------------------------


def survivor_rank(rows: DataFrame, clusters: DataFrame, columns: Sequence[str], *, locked: DataFrame | None = None, trust: Sequence[str] = ()) -> DataFrame:
    """(row_id, cluster_id, rank, source, raw columns): members in survivor order.

    rows: (row_id, row_number, source, n, columns). Order: chosen by a user, trusted source, number of verified
    identifiers and contacts, completeness, source, row number, row id. rank is the ordering value, least first.
    """
    n = F.col("n")
    verified = (F.size(n["identifier"]) + F.size(n["phone"]) + F.size(n["email"])) if "n" in rows.columns else F.lit(0)
    complete = sum((F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0))
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in trust]).cast("array<string>"), F.col("source")), F.lit(0)), F.lit(len(trust) + 1))
    kept = rows.join(clusters.select("row_id", "cluster_id"), "row_id")
    if locked is not None:
        kept = kept.join(locked.select("row_id").distinct().withColumn("_locked", F.lit(True)), "row_id", "left")
    rank = F.struct(F.col("_locked").isNull().alias("a") if locked is not None else F.lit(True).alias("a"), order.alias("b"), (-verified).alias("c"), (-complete).alias("d"), F.coalesce("source", F.lit("")).alias("e"), F.col("row_number").alias("f"), F.col("row_id").alias("g"))
    return kept.select("row_id", "cluster_id", rank.alias("rank"), "source", *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def canonicalize(ranked: DataFrame, columns: Sequence[str], overrides: DataFrame | None = None, role_mappings: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """(cluster_id, survivor_row_id, column_name, value, row_id, rule, conflicts): the value of every column of every cluster, where it came from, and whether members disagree.

    ranked: from :func:`survivor_rank`; overrides: (row_id, column_name) chosen by a reviewer. rule: reviewer_choice
    (its value may be empty), survivor, fill_from_member, or null where all are empty. conflicts is the number of
    different filled values if there are several, else 0. With role_mappings (source -> column -> role) the columns
    ``canonical.<role>`` are added, the first filled value in rank order by each row's own mapping.
    Every figure is a minimum or a count, so a giant cluster is aggregated and never collected.
    """
    top = ranked.groupBy("cluster_id").agg(F.min_by("row_id", "rank").alias("survivor_row_id"))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value"), F.lit(False).alias("by_role")) for c in columns]
    if role_mappings:
        for source, mapping in role_mappings.items():
            cells += [F.when(F.coalesce("source", F.lit("default")) == source, F.struct(F.lit(f"canonical.{role}").alias("column_name"), F.col(f"`{c}`").alias("value"), F.lit(True).alias("by_role"))) for c, role in mapping.items() if role not in ("other", "ignore")]
    long = ranked.select("cluster_id", "row_id", "rank", F.explode(F.array_compact(F.array(*cells))).alias("e")).select("cluster_id", "row_id", "rank", "e.*")
    if overrides is not None:
        long = long.join(overrides.select("row_id", "column_name").distinct().withColumn("chosen", F.lit(True)), ["row_id", "column_name"], "left")
    else:
        long = long.withColumn("chosen", F.lit(None).cast("boolean"))
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    pick = lambda cond: F.min(F.when(cond, F.struct("rank", "row_id", F.coalesce("value", F.lit("")).alias("value"))))
    got = long.groupBy("cluster_id", "column_name").agg(pick(F.col("chosen")).alias("c"), pick(filled).alias("f"), F.count_distinct(F.when(filled & ~F.col("by_role"), F.col("value"))).alias("different"), F.max("by_role").alias("by_role"))
    got = got.join(top, "cluster_id").where("NOT by_role OR f IS NOT NULL")
    by = F.when(F.col("by_role"), F.when(F.col("f.row_id") == F.col("survivor_row_id"), "role_from_survivor").otherwise("role_from_member")).otherwise(F.when(F.col("f.row_id") == F.col("survivor_row_id"), "survivor").otherwise("fill_from_member"))
    rule = F.when(F.col("c").isNotNull(), "reviewer_choice").when(F.col("f").isNotNull(), by)
    return got.select("cluster_id", "survivor_row_id", "column_name", F.coalesce("c.value", "f.value", F.lit("")).alias("value"), F.coalesce("c.row_id", "f.row_id").alias("row_id"), rule.alias("rule"), F.when(F.col("different") > 1, F.col("different")).otherwise(0).alias("conflicts"))


# --- a whole run ------------------------------------------------------------------------------------------------------


def run_match(datasets: Mapping[str, DataFrame], mappings: Mapping[str, Mapping[str, str]], row_id: str, *, strictness: str = "conservative", max_block_size: int = 200, region: str = "US", person: bool = False, constraints: DataFrame | None = None, locks: DataFrame | None = None) -> dict[str, DataFrame]:
    """normalized, keys, decisions, clusters and bridges of rows of one or several datasets, each with its own mapping.

    Rows pair within and across datasets. A bridge (one match between two groups of two or more) goes to review.
    """
    validate_request(mappings, strictness=strictness, max_block_size=max_block_size, region=region)
    scratch = Scratch(next(iter(datasets.values())).sparkSession)
    rows = None
    for name, df in datasets.items():
        one = nz.normalized(df, row_id, mappings[name], region).withColumn("source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    rows = scratch.cut(rows)
    keys = scratch.cut(block_keys(rows, person=person))
    decided = scratch.cut(decide(compare(candidates(keys, max_block_size), rows, person=person), strictness))
    clusters, bridges = cluster(rows, decided, constraints, locks, person=person)
    moved = bridges.withColumn("_bridge", F.lit(True))
    final = decided.join(moved, "decision_id", "left").withColumns({"decision": F.when(F.col("_bridge"), "possible_match").otherwise(F.col("decision")), "reason": F.when(F.col("_bridge"), "Needs review: a single match would join two groups").otherwise(F.col("reason"))}).drop("_bridge")
    return {"normalized": rows, "keys": keys, "decisions": final, "clusters": clusters, "bridges": bridges}


def run_metrics(result: Mapping[str, DataFrame], max_block_size: int = 200) -> DataFrame:
    """(metric, value) of a run: decisions by kind and scope, reasons of contradictions, blocks, cluster sizes."""
    d, rows = result["decisions"], result["normalized"].select("row_id", "source")
    metric = lambda df, name: df.select(F.concat(F.lit(f"{name}:"), F.col(df.columns[0]).cast("string")).alias("metric"), F.col(df.columns[1]).cast("long").alias("value"))
    sides = d.join(rows.select(F.col("row_id").alias("left"), F.col("source").alias("ls")), "left").join(rows.select(F.col("row_id").alias("right"), F.col("source").alias("rs")), "right")
    scope = sides.groupBy(F.concat_ws(":", F.when(F.col("ls") == F.col("rs"), "within").otherwise("across"), "decision").alias("k")).count()
    guards = d.select(F.explode("evidence").alias("e")).where("e.strength = 'guard'").groupBy(F.concat_ws(":", "e.field", "e.explanation").alias("k")).count()
    sizes = result["clusters"].groupBy("cluster_id").count().groupBy(F.when(F.col("count") == 1, "1").when(F.col("count") == 2, "2").when(F.col("count") <= 5, "3-5").when(F.col("count") <= 10, "6-10").otherwise("11+").alias("k")).count()
    b = block_sizes(result["keys"])
    blocks = b.agg(F.count_if(F.col("size") >= 2).alias("blocks"), F.max("size").alias("max_block_size"), F.count_if((F.col("size") >= 2) & (F.col("counted") > max_block_size)).alias("oversized"))
    blocks = blocks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("long").alias("v")) for c in blocks.columns])).alias("e")).select("e.*")
    out = metric(d.groupBy("decision").count(), "decisions").unionByName(metric(scope, "scope")).unionByName(metric(guards, "guard"))
    return out.unionByName(metric(sizes, "cluster_size")).unionByName(metric(blocks, "block")).unionByName(metric(result["bridges"].agg(F.lit("rejected").alias("k"), F.count("*").alias("count")), "bridge"))

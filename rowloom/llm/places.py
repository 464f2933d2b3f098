"""Problem 1: the same postal address written differently, by top-down hierarchy matching.

The levels are region (postal code), locality, street, number and unit. Going down, a spelling of a locality or street
is linked to the likeliest spellings of its region, and the candidates are pruned by what exists on the next level: a
street spelling takes the place of another only where the other has the same number and unit. On every level a missing
part (locality, direction, prefix, street type, region) inherits the only candidate its siblings leave; where they leave
several it stays open, and :func:`open_candidates` gives out the whole candidate set instead of a guess.

Work is done on distinct written forms with their counts; rows meet only in the last join. All joins use composite keys
of several levels, so a region with a third of all rows is spread over its streets and house numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.parse import PARTS, address_column, deletions
from rowloom.runtime import Scratch, one_per

CELL = ["zip", "number", "unit"]
OPTIONAL = ("direction", "prefix", "kind")
WRITTEN = ["zip", "town", "number", "unit", "direction", "prefix", "street", "kind"]


def _near(a: Column, b: Column) -> Column:
    """At most one typo in short words, two in long ones; for words that share a form with one letter lost."""
    return F.levenshtein(a, b) <= F.when(F.least(F.length(a), F.length(b)) >= 7, 2).otherwise(1)


def _alike(words: DataFrame, column: str, seen: str) -> DataFrame:
    """(zip, column, other, other_seen): the other spellings of the region that are a typo away."""
    keyed = words.select("zip", column, seen, F.explode(deletions(F.col(column))).alias("key"))
    other = keyed.select("zip", "key", F.col(column).alias("other"), F.col(seen).alias("other_seen"))
    met = keyed.join(other, ["zip", "key"]).where(F.col(column) != F.col("other")).where(_near(F.col(column), F.col("other")))
    return met.select("zip", column, "other", "other_seen").distinct()


def _close_open(rows: DataFrame) -> DataFrame:
    """Rows whose street and town were written without a mark between them, cut where the region's known localities or, failing that, its known streets say."""
    sure, unsure = rows.where("open = ''").drop("open"), rows.where("open <> ''").drop("open")
    words = F.split("street", " ")
    cut = unsure.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(F.array_join(F.slice(words, 1, k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest")))).alias("k", "cut"))
    cut = cut.select(*unsure.columns, "k", F.col("cut.head").alias("head"), F.col("cut.rest").alias("rest"))
    towns = sure.where("town <> ''").select("zip", F.col("town").alias("rest")).distinct().withColumn("is_town", F.lit(1))
    streets = sure.select("zip", F.col("street").alias("head")).distinct().withColumn("is_street", F.lit(1))
    known = cut.join(towns, ["zip", "rest"], "left").join(streets, ["zip", "head"], "left").na.fill(0, ["is_town", "is_street"])
    # the longest known locality, else the longest known street, else all words are the street
    rank = F.struct(F.col("is_town"), F.when(F.col("is_town") == 1, F.length("rest")).otherwise(0).alias("l"), "is_street", "k", "head", "rest")
    best = known.groupBy("id").agg(F.max(rank).alias("b"), *[F.first(c).alias(c) for c in unsure.columns if c not in ("id", "street", "town")])
    resolved = best.select(*[F.col("b.head").alias(c) if c == "street" else F.col("b.rest").alias(c) if c == "town" else F.col(c) for c in unsure.columns])
    return sure.unionByName(resolved)


def _localities(forms: DataFrame) -> DataFrame:
    """(zip, town, locality): the spelling that stands for each spelling of a town in its region, the one seen most often among those a typo away."""
    towns = forms.where("town <> ''").groupBy("zip", "town").agg(F.sum("n").alias("seen"))
    own = towns.select("zip", "town", F.col("town").alias("other"), F.col("seen").alias("other_seen"))
    return _alike(towns, "town", "seen").unionByName(own).groupBy("zip", "town").agg(F.max(F.struct("other_seen", "other")).alias("b")).select("zip", "town", F.col("b.other").alias("locality"))


def _settle_streets(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(zip, number, unit, street, main): the spelling that stands for each spelling of a street at one number and unit, where it is another one.

    On the street level every spelling has the spellings of its region that are a typo away as candidates; the number
    and unit level keeps those that exist there too. The more often a spelling occurs in its region, the likelier it is meant.
    """
    spelt = forms.where("number <> 'box'").groupBy(*CELL, "street").agg(F.sum("n").alias("n"))
    regional = spelt.groupBy("zip", "street").agg(F.sum("n").alias("seen"))
    # a spelling that is alone at all its numbers and units has nothing to be told from
    several = spelt.groupBy(*CELL).agg(F.min("street").alias("lo"), F.max("street").alias("hi")).where("lo <> hi").select(*CELL)
    many = scratch.cut(spelt.join(several, CELL, "left_semi").select(*CELL, "street").join(regional, ["zip", "street"]))
    alike = _alike(many.select("zip", "street", "seen").distinct(), "street", "seen")
    here = many.select(*CELL, F.col("street").alias("other"))
    linked = many.join(alike, ["zip", "street"]).join(here, [*CELL, "other"], "left_semi").select(*CELL, "street", "other", "other_seen")
    own = many.select(*CELL, "street", F.col("street").alias("other"), F.col("seen").alias("other_seen"))
    best = linked.unionByName(own).groupBy(*CELL, "street").agg(F.max(F.struct("other_seen", "other")).alias("b")).select(*CELL, "street", F.col("b.other").alias("main"))
    best = scratch.cut(best.where("street <> main"))
    over = best.select(*CELL, F.col("street").alias("main"), F.col("main").alias("top"))
    settled = scratch.cut(best.join(over, [*CELL, "main"], "left").select(*CELL, "street", F.coalesce("top", "main").alias("main")))
    scratch.drop(many, best)
    return settled


def _inherit(forms: DataFrame, within: list[str], part: str) -> DataFrame:
    """Fill a missing part with the only value that the other forms of the group have; where there are several, it stays open."""
    values = forms.where(F.col(part) != "").groupBy(*within).agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
    filled = forms.join(values, within, "left")
    return filled.withColumn(part, F.when((F.col(part) == "") & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col(part))).drop("lo", "hi")


def parts_of(addresses: DataFrame) -> DataFrame:
    """(id, parts) of every row whose address can be parsed."""
    return addresses.select("id", address_column(F.col("address"), F.col("zip"), F.col("town")).alias("p")).where("p.number IS NOT NULL").select("id", *[f"p.{c}" for c in PARTS])


def _descend(addresses: DataFrame, scratch: Scratch, parsed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their written parts, the place of every written form that is certain, and the candidates of those that are not.

    addresses: (id, address, zip, town), all but id strings. A place is the text of its resolved levels, so that equal places are equal in all of them.
    """
    raw = scratch.cut(parts_of(addresses)) if parsed is None else parsed
    rows = scratch.cut(_close_open(raw))
    forms = scratch.cut(rows.groupBy(*WRITTEN).agg(F.count("*").alias("n")))
    if parsed is None:
        scratch.drop(raw)
    here = forms.where("zip <> ''")

    # locality: the town that is written, else the only one of the region, else what the siblings of the address agree on, else open
    local = scratch.cut(_localities(here))
    only = local.groupBy("zip").agg(F.min("locality").alias("lo"), F.max("locality").alias("hi")).select("zip", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("sole"))
    placed = here.join(local, ["zip", "town"], "left").join(only, "zip", "left").withColumn("locality", F.coalesce("locality", "sole", F.lit(""))).drop("sole")
    # street, number and unit
    main = _settle_streets(here, scratch)
    settled = placed.join(main, [*CELL, "street"], "left").withColumn("main", F.coalesce("main", "street"))
    group = [*CELL, "main"]
    wide = settled.select(*WRITTEN, "n", "main", "locality", *[F.col(o).alias(f"s_{o}") for o in OPTIONAL])
    wide = _inherit(wide, group, "locality")
    group = [*group, "locality"]
    for part in ("s_kind", "s_prefix", "s_direction"):
        wide = _inherit(wide, group, part)
        group = [*group, part]
    place = F.concat_ws("|", "zip", "locality", "main", *[f"s_{o}" for o in OPTIONAL], "number", "unit")
    wide = scratch.cut(wide.withColumn("place", place))

    # rows without region, and rows alone in theirs whose code is one slip away from another, inherit a region if exactly one place fits
    places = wide.groupBy("zip", "number", "unit", "main", *[f"s_{o}" for o in OPTIONAL], "place").agg(F.sum("n").alias("rows"), F.max(F.coalesce(F.nullif("locality", F.lit("")), "town")).alias("t_town"))
    street_rows = wide.groupBy("zip", "main").agg(F.sum("n").alias("street_rows"))
    lone = wide.join(street_rows, ["zip", "main"]).where("street_rows = n AND number <> 'box'")
    seek = forms.where("zip = ''").select(*WRITTEN, "n", F.lit(None).cast("string").alias("place"))
    seek = seek.unionByName(lone.select(*seek.columns))
    keys = seek.withColumn("key", F.explode(F.when(F.col("number") == "box", F.array("street")).otherwise(deletions(F.col("street")))))
    target = places.select(
        F.col("zip").alias("t_zip"), "number", "unit", F.col("main").alias("t_main"), "t_town", F.col("place").alias("t_place"), "rows", *[F.col(f"s_{o}").alias(f"t_{o}") for o in OPTIONAL],
        F.explode(F.when(F.col("number") == "box", F.array("main")).otherwise(deletions(F.col("main")))).alias("key"),
    )
    fits = keys.join(target, ["number", "unit", "key"]).where(_near(F.col("street"), F.col("t_main")))
    for o in OPTIONAL:
        fits = fits.where(F.col(o).isin("") | F.col(f"t_{o}").isin("") | (F.col(o) == F.col(f"t_{o}")))
    same_town = (F.col("town") != "") & (F.col("t_town") != "") & (F.levenshtein("town", "t_town") <= 2)
    slip = (F.levenshtein("zip", "t_zip") == 1) | ((F.levenshtein("zip", "t_zip") == 2) & (F.array_sort(F.split("zip", "")) == F.array_sort(F.split("t_zip", ""))))
    agree = F.when(F.col("zip") == "", (F.col("number") != "box") | same_town).otherwise(slip & (F.col("rows") > F.col("n")))
    no_quarrel = (F.col("town") == "") | (F.col("t_town") == "") | same_town
    fits = fits.where(agree & no_quarrel & (F.col("place").isNull() | (F.col("place") != F.col("t_place"))))
    fits = scratch.cut(fits.select(*WRITTEN, "place", "t_place").distinct())

    def sole(f: DataFrame) -> DataFrame:
        return f.groupBy(*WRITTEN).agg(F.min("t_place").alias("lo"), F.max("t_place").alias("hi"), F.min("place").alias("place")).where("lo = hi").select(*WRITTEN, F.col("lo").alias("inherited"), "place")

    slipped = scratch.cut(sole(fits.where("zip <> ''")))
    # a place that was only a slip of another is none to choose from
    candidates = fits.where("zip = ''").join(slipped.select(F.col("place").alias("t_place")).distinct(), "t_place", "left_anti")
    chosen = slipped.unionByName(sole(candidates)).drop("place")
    alone = F.when(F.col("number") != "box", F.concat_ws("|", F.lit(""), "town", "street", *OPTIONAL, "number", "unit"))
    own = wide.select(*WRITTEN, "place").unionByName(forms.where("zip = ''").select(*WRITTEN, alone.alias("place")))
    final = scratch.cut(own.join(chosen, WRITTEN, "left").select(*WRITTEN, F.coalesce("inherited", "place").alias("place")).where("place IS NOT NULL"))
    several = candidates.select(*WRITTEN, F.col("t_place").alias("place")).join(chosen.select(*WRITTEN), WRITTEN, "left_anti")
    return rows, final, several


def locate(addresses: DataFrame, scratch: Scratch, parsed: DataFrame | None = None) -> DataFrame:
    """(id, place) for every address that denotes a place.

    addresses: (id, address, zip, town), all but id strings; parsed: their :func:`parts_of`, if at hand. Rows without a usable address, and boxes without region
    whose place is ambiguous, have no place; a house without region that fits several places is a place by itself.
    """
    rows, final, _ = _descend(addresses, scratch, parsed)
    return scratch.cut(rows.join(final, WRITTEN).select("id", "place"))


def _base(people: DataFrame) -> DataFrame:
    return one_per(people.select(F.col("row_id").cast("long").alias("id"), "address", "zip"), ["id"])


def open_candidates(people: DataFrame) -> DataFrame:
    """(row_id, place, candidates): the candidate places of every row whose address has no region and fits several, one row per candidate, with their number.

    people: people_export; only row_id, address and zip are read. Rows that are certain, or fit no other place, do not occur; an empty table gives none.
    """
    scratch = Scratch(people.sparkSession)
    rows, _, several = _descend(_base(people).withColumn("town", F.lit(None).cast("string")), scratch)
    sized = several.join(several.groupBy(*WRITTEN).agg(F.count("*").alias("candidates")), WRITTEN)
    return rows.where("zip = ''").join(sized, WRITTEN).select(F.col("id").alias("row_id"), "place", "candidates")


def _distinct_spellings(people: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, id, spelling) of the rows at places with several spellings of the address."""
    base = scratch.cut(_base(people))
    at = locate(base.withColumn("town", F.lit(None).cast("string")), scratch)
    text = scratch.cut(at.join(base.select("id", F.md5("address").alias("spelling")), "id"))
    scratch.drop(at, base)
    several = text.groupBy("place").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("place")
    return text.join(several, "place", "left_semi")


def same_places(people: DataFrame) -> DataFrame:
    """(left_row_id, right_row_id): pairs of rows at one location whose address texts are not identical.

    people: people_export; columns other than row_id, address and zip are ignored and may clash with nothing. Null,
    blank and stand-in addresses, addresses without house number or box and ambiguous ones take part in no pair;
    repeated row_ids count once; an empty table gives no pairs.
    """
    text = _distinct_spellings(people, Scratch(people.sparkSession))
    left = text.select("place", F.col("id").alias("left_row_id"), F.col("spelling").alias("ls"))
    right = text.select("place", F.col("id").alias("right_row_id"), F.col("spelling").alias("rs"))
    return left.join(right, "place").where("left_row_id < right_row_id AND ls <> rs").select("left_row_id", "right_row_id")


def place_members(people: DataFrame) -> DataFrame:
    """(row_id, place, rows, spellings): the form of :func:`same_places` that grows with the rows and not with their pairs; places of one spelling are left out."""
    text = _distinct_spellings(people, Scratch(people.sparkSession))
    size = text.groupBy("place", "spelling").agg(F.count("*").alias("n")).groupBy("place").agg(F.sum("n").alias("rows"), F.count("*").alias("spellings"))
    return text.join(size, "place").select(F.col("id").alias("row_id"), "place", "rows", "spellings")

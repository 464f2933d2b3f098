"""Problem 2: variant spellings of names, by noisy-channel attribution.

A spelling only stands for a person in a context: a telephone, a place, or an e-mail address, unless different names
spread it over several regions. In each context the distinct spellings compete: every spelling is attached to the candidate with
the highest posterior, the product of a frequency prior (how often the candidate is written in the context and
overall, and how complete it is) and the likelihood of the typos, abbreviations and nicknames that turn the candidate
into the spelling. The likelihoods of the channel are learned: how often each of them happens to a word is counted over
all contexts that hold just two spellings. A spelling that two different people explain equally well is attached to
neither. Attached spellings and copies form the links whose connected groups are the entities.

In contexts with few spellings all of them meet; in larger ones (a shared switchboard, a default value) they meet by
tokens, of which any two spellings of one name share one that is equal or a typo apart. Both ways give the same pairs,
so the size of a context decides only how they are found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import group_linked
from rowloom.llm.parse import CHANNEL, all_tokens_of, close_to, differ, name_column, ops_of, phone_column, zip_column
from rowloom.llm.places import locate
from rowloom.llm.typos import alike
from rowloom.runtime import Scratch, one_per


def contacts(rows: DataFrame, scratch: Scratch, parsed: DataFrame | None = None) -> DataFrame:
    """(id, form, phone, zip, place, email) of every row with a usable name.

    rows: (id, name, phone, email, address, zip, town), all but id strings; parsed: their addresses by :func:`parts_of`, if at hand.
    """
    at = locate(rows.select("id", "address", "zip", "town"), scratch, parsed)
    email = F.lower(F.trim("email"))
    parts = rows.select("id", name_column(F.col("name")).alias("form"), phone_column(F.col("phone")).alias("phone"), zip_column(F.col("zip")).alias("zip"), F.when(email.rlike("^[^@ ]+@[^@ ]+$"), email).alias("email"))
    return scratch.cut(parts.where("form IS NOT NULL").join(at, "id", "left").select("id", "form", "phone", "zip", "place", "email"))


def _contexts(known: DataFrame) -> DataFrame:
    """(key, form, id): the contexts of every row. An e-mail address seen in several regions counts apart in each of them if its names contradict each other (a default value); one person's goes with them."""
    mail = known.where("email IS NOT NULL")
    spread = mail.groupBy("email").agg(F.min("zip").alias("lo"), F.max("zip").alias("hi"), F.max_by("form", F.struct(F.length("form"), "form")).alias("fullest")).where("lo <> hi")
    # every name is held against the fullest one, so that a default value costs no more than its rows
    names = mail.select("email", "form").distinct().join(spread.select("email", "fullest"), "email")
    split = names.where(differ("form", "fullest")).select("email").distinct().withColumn("apart", F.lit(True))
    mail = mail.join(split, "email", "left").where("apart IS NULL OR zip IS NOT NULL").select(F.concat_ws("|", F.lit("m"), "email", F.when(F.col("apart"), F.col("zip")).otherwise(F.lit(""))).alias("key"), "form", "id")
    phone = known.where("phone IS NOT NULL").select(F.concat_ws("|", F.lit("t"), "phone").alias("key"), "form", "id")
    place = known.where("place IS NOT NULL").select(F.concat_ws("|", F.lit("a"), "place").alias("key"), "form", "id")
    return phone.unionByName(place).unionByName(mail)


def _full(form: Column) -> Column:
    """How complete a form is: words written out count 2, initials 1, a suffix 1."""
    words = F.split(F.element_at(F.split(form, r"\|"), 3), " ")
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.when(F.length(w) > 1, 2).otherwise(1)) + F.when(F.element_at(F.split(form, r"\|"), 2) != "", 1).otherwise(0)


def _may_be_close(a: Column, b: Column) -> Column:
    """What :func:`close` needs, told inside the JVM: each swap of neighbours costs two plain edits but leaves the letters the same."""
    plain = F.levenshtein(a, b)
    letters = F.levenshtein(F.array_join(F.array_sort(F.split(a, "")), ""), F.array_join(F.array_sort(F.split(b, "")), ""))
    return F.when(plain <= 1, True).when(F.least(F.length(a), F.length(b)) < 8, (plain == 2) & (letters == 0)).otherwise((plain == 2) | (plain == 3) & (letters <= 2) | (plain == 4) & (letters == 0))


def near_tokens(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, other): every token of the left that is equal to one of the right or a typo away. Those after # only equal each other, those after + only meet single words."""

    bare = lambda c: F.ltrim(c, F.lit("+"))
    mine, theirs = scratch.cut(left.select("token").distinct()), scratch.cut(right.select("token").distinct())
    both = mine.select("token", F.lit(1).alias("side")).unionByName(theirs.select("token", F.lit(2).alias("side"))).where(~F.col("token").startswith("#") & (F.length(bare("token")) >= 3))
    side = both.groupBy("token").agg(F.sum("side").alias("side"))
    flags = F.col("side") + F.when(F.col("token").startswith("+"), 4).otherwise(0)
    words = scratch.cut(side.select("token", (F.monotonically_increasing_id() * 8 + flags).alias("id")))
    met = alike(words.select("id", bare("token").alias("word")))
    met = met.join(words.select(F.col("id").alias("a"), "token"), "a").join(words.select(F.col("id").alias("b"), F.col("token").alias("other")), "b")
    near = scratch.cut(met.select("token", "other").where(_may_be_close(bare("token"), bare("other"))).where(close_to(bare("token"), bare("other"))))
    scratch.drop(words)
    same = mine.where("token NOT LIKE '+%'").join(theirs, "token", "left_semi").select("token", F.col("token").alias("other"))
    return same.unionByName(near)


def _meetings(sized: DataFrame, outright: int, scratch: Scratch) -> DataFrame:
    """(key, form, main): every ordered pair of spellings of one context that could be one name."""
    few = sized.where(F.col("k") <= outright)
    pairs = few.select("key", "form").join(few.select("key", F.col("form").alias("main")), "key").where("form <> main")
    many = sized.where(F.col("k") > outright).select("key", "form")
    if many.isEmpty():
        return pairs
    token = scratch.cut(many.select("form").distinct().select("form", F.explode(all_tokens_of("form")).alias("token")))
    near = near_tokens(token, token, scratch)
    left = many.join(token, "form").join(near, "token").select("key", "form", F.col("other").alias("token"))
    right = many.join(token, "form").select("key", "token", F.col("form").alias("main"))
    return pairs.unionByName(left.join(right, ["key", "token"]).where("form <> main").select("key", "form", "main").distinct())


def channel_costs(both: DataFrame, priced: DataFrame) -> dict[str, float]:
    """Negative log-likelihood of what the channel does to a word, counted over the contexts of two spellings; one row comes to the driver."""
    pair = both.where("k = 2 AND form < main").join(priced, ["form", "main"])
    row = pair.agg(*[F.sum(c).alias(c) for c in (*CHANNEL, "words")]).first()
    words = row["words"] or 0
    total = words + 20.0
    return {c: -math.log(((row[c] or 0) + 20.0 * math.exp(-1 - first)) / total) for c, first in CHANNEL.items()}


def attribute(spelt: DataFrame, scratch: Scratch, *, outright: int = 40, lead: float = 0.7) -> DataFrame:
    """(key, form, main): the spelling that each spelling of a context is attached to.

    spelt: (key, form, n, seen), n being the rows of the spelling in its context and seen in the whole table. The
    posterior (log) is log(1 + n) + 0.3 log(seen) + completeness + log-likelihood of the channel. A spelling is left
    alone if the best candidate leads a candidate that is a different person from it by less than ``lead``.
    ``outright`` is where contexts are searched by tokens; it does not change the result.
    """
    size = spelt.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    prior = F.log(1 + F.col("n")) + 0.3 * F.log("seen") + 0.5 * _full(F.col("form"))
    sized = scratch.cut(spelt.join(size, "key").select("key", "form", "k", prior.alias("prior")))
    both = scratch.cut(_meetings(sized, outright, scratch).join(size, "key"))
    # one comparison of each pair of spellings, whatever the number of contexts they share
    compared = both.where("form < main").select("form", "main").distinct().repartition(F.col("form")).withColumn("o", ops_of("form", "main"))
    priced = scratch.cut(compared.select("form", "main", "o.*").where("words IS NOT NULL"))
    costs = channel_costs(both, priced)
    cost = sum((F.lit(v) * F.col(c) for c, v in costs.items()), F.lit(0.0))
    either = priced.select("form", "main", cost.alias("cost"))
    either = either.unionByName(either.select(F.col("main").alias("form"), F.col("form").alias("main"), "cost"))
    cand = both.select("key", "form", "main").join(either, ["form", "main"])
    top = sized.select("key", F.col("form").alias("main"), "prior")
    own = sized.select("key", "form", F.col("prior").alias("own"))
    # the forest points upwards only: to a candidate with a higher prior, ties by spelling
    up = cand.join(top, ["key", "main"]).join(own, ["key", "form"]).where("prior > own OR (prior = own AND main < form)")
    up = scratch.cut(up.select("key", "form", "main", (F.col("prior") - F.col("cost")).alias("post")))
    scratch.drop(sized, both)
    best = up.groupBy("key", "form").agg(F.max(F.struct("post", "main")).alias("b")).select("key", "form", F.col("b.main").alias("main"), F.col("b.post").alias("post"))
    # a rival: another candidate nearly as good that cannot be the same person as the best
    rival = up.select("key", "form", F.col("main").alias("other"), F.col("post").alias("other_post")).join(best, ["key", "form"]).where((F.col("other") != F.col("main")) & (F.col("other_post") > F.col("post") - lead))
    foes = rival.join(either.select(F.col("form").alias("main"), F.col("main").alias("other"), "cost"), ["main", "other"], "left").where("cost IS NULL").select("key", "form").distinct()
    attached = scratch.cut(best.join(foes, ["key", "form"], "left_anti").select("key", "form", "main"))
    scratch.drop(up, priced)
    return attached


def entities(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_id, group_id) of rows that are one person or organisation; only rows linked to another."""
    ctx = scratch.cut(_contexts(known))
    seen = known.groupBy("form").agg(F.count("*").alias("seen"))
    spelt = scratch.cut(ctx.groupBy("key", "form").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    main = attribute(spelt.join(seen, "form").select("key", "form", "n", "seen"), scratch)
    # a spelling of initials alone does not by itself make two rows of a context one person, written-out names do
    rep = spelt.select("key", "form", "first")
    copies = ctx.join(rep, ["key", "form"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    merged = main.join(rep, ["key", "form"]).join(rep.select("key", F.col("form").alias("main"), F.col("first").alias("top")), ["key", "main"]).where("first <> top").select(F.col("first").alias("a"), F.col("top").alias("b"))
    return group_linked(copies.unionByName(merged), "a", "b", scratch=scratch)


def _grouped(people: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(group_id, id, form, spelling) of the rows of groups with several spellings, and (lf, rf), the pairs of forms of one group that do not contradict each other."""
    base = scratch.cut(one_per(people.select(F.col("row_id").cast("long").alias("id"), "name", "phone", "email", "address", "zip"), ["id"]))
    known = contacts(base.withColumn("town", F.lit(None).cast("string")), scratch)
    group = entities(known, scratch).select(F.col("row_id").alias("id"), "group_id").join(known.select("id", "form"), "id")
    text = scratch.cut(group.join(base.select("id", F.md5("name").alias("spelling")), "id"))
    scratch.drop(base, known)
    several = text.groupBy("group_id").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("group_id")
    text = scratch.cut(text.join(several, "group_id", "left_semi"))
    # a chain of spellings may have joined relatives: forms that contradict each other are held against each other once, whatever the rows
    form = text.select("group_id", "form").distinct()
    met = form.select("group_id", F.col("form").alias("lf")).join(form.select("group_id", F.col("form").alias("rf")), "group_id").where("lf < rf").select("lf", "rf").distinct()
    agree = scratch.cut(met.where(~differ("lf", "rf")))
    same = form.select(F.col("form").alias("lf"), F.col("form").alias("rf")).distinct()
    return text, same.unionByName(agree).unionByName(agree.select(F.col("rf").alias("lf"), F.col("lf").alias("rf")))


def same_names(people: DataFrame) -> DataFrame:
    """(left_row_id, right_row_id): pairs of rows of one person or organisation whose name texts are not identical.

    people: people_export; only row_id, name, phone, email, address and zip are read. Null, blank and stand-in names
    take part in no pair; null or stand-in contacts are no context; repeated row_ids count once; an empty table gives
    no pairs.
    """
    text, agree = _grouped(people, Scratch(people.sparkSession))
    left = text.select("group_id", F.col("id").alias("left_row_id"), F.col("spelling").alias("ls"), F.col("form").alias("lf"))
    right = text.select("group_id", F.col("id").alias("right_row_id"), F.col("spelling").alias("rs"), F.col("form").alias("rf"))
    return left.join(right, "group_id").where("left_row_id < right_row_id AND ls <> rs").join(agree, ["lf", "rf"], "left_semi").select("left_row_id", "right_row_id")


def name_members(people: DataFrame) -> DataFrame:
    """(row_id, group_id, spellings): the form of :func:`same_names` that grows with the rows and not with their pairs; spellings counts the distinct name texts of the group."""
    text, _ = _grouped(people, Scratch(people.sparkSession))
    size = text.select("group_id", "spelling").distinct().groupBy("group_id").agg(F.count("*").alias("spellings"))
    return text.join(size, "group_id").select(F.col("id").alias("row_id"), "group_id", "spellings")

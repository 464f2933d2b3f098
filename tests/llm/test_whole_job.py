"""Cases that a cap, a prefix or a switch by size would lose."""

import datetime as dt
import random

import numpy as np

from rowloom.llm import parse
from rowloom.llm.names import attribute, name_members, same_names
from rowloom.llm.packing import best_fit, fill_containers, fill_report
from rowloom.llm.places import open_candidates, place_members, same_places
from rowloom.llm.residue import residue
from rowloom.llm.sentences import Model
from rowloom.llm.survivors import acyclic, survivors
from rowloom.runtime import Scratch

PEOPLE = "row_id long, name string, phone string, email string, address string, zip string"
REC = "struct<title:string,description:string,price:string,author:string,source_url:string>"


def people(spark, rows):
    return spark.createDataFrame(rows, PEOPLE)


def test_a_notice_stays_a_case_however_often_a_host_shows_it(spark):
    for n in (3, 19, 25, 60):
        rows = [(i, "https://a.example/x", [(f"Desk {i}", f"Oak desk number {i}.\nEnable JavaScript to continue.", None, None, None), (f"Lamp {i}", f"Lamp {i} of brass.\nBack to the list", "undefined", None, None)], []) for i in range(n)]
        got = {(x.run_id, x.item_pos) for x in residue(spark.createDataFrame(rows, f"run_id long, source_url string, records array<{REC}>, warnings array<string>")).collect()}
        assert got == {(i, k) for i in range(n) for k in (0, 1)}


def test_boilerplate_makes_the_rest_the_whole(spark):
    # "None" beside a line that the host shows beside ever different texts is all that is left of its field; beside real content it is not
    rows = [(i, "https://a.example/x", [("Desk", f"Oak desk {i} of the old mill.\nBack to the list", None, None, None)], []) for i in range(30)]
    rows += [(90, "https://a.example/x", [("Desk", "None\nBack to the list", None, None, None), ("Desk", "None\nA desk of oak, made by hand.", None, None, None)], [])]
    got = {(x.run_id, x.item_pos) for x in residue(spark.createDataFrame(rows, f"run_id long, source_url string, records array<{REC}>, warnings array<string>")).collect()}
    assert got == {(90, 0)}


def test_streets_of_several_words_and_composed_units(spark):
    rows = [
        (1, None, None, None, "12 Oak Hill Dr", "12345"), (2, None, None, None, "12 Oak Park Dr", "12345"), (3, None, None, None, "12 Martin Luther King Blvd", "12345"), (4, None, None, None, "12 Martin Van Buren Ave", "12345"), (5, None, None, None, "12 OAK HILL DRIVE", "12345"),
        (6, None, None, None, "12B Oak St", "12345"), (7, None, None, None, "12 Oak Street Apt B", "12345"), (8, None, None, None, "100 Oak St Bldg 2 Apt 3", "12345"), (9, None, None, None, "100 Oak St Bldg 2 Apt 4", "12345"), (10, None, None, None, "Apt 3, Building 2, 100 Oak Street", "12345"),
        (11, None, None, None, "100 Oak St Apt 12-B", "12345"), (12, None, None, None, "100 Oak St #12B", "12345"), (13, None, None, None, "12 Martin Luther King Boulevard, Larkham", "12345"),
    ]
    assert {tuple(x) for x in same_places(people(spark, rows)).collect()} == {(1, 5), (6, 7), (8, 10), (11, 12), (3, 13)}
    assert {x.row_id for x in place_members(people(spark, rows)).collect()} == {1, 5, 6, 7, 8, 10, 11, 12, 3, 13}


def test_ambiguity_stays_explicit(spark):
    rows = [(1, None, None, None, "7 Larkleham St", "12345"), (2, None, None, None, "7 Larkleham Street", "54321"), (3, None, None, None, "7 LARKLEHAM ST", None), (4, None, None, None, "9 Larkleham St", "12345"), (5, None, None, None, "9 larkleham street", "")]
    found = {(x.row_id, x.place, x.candidates) for x in open_candidates(people(spark, rows)).collect()}
    assert {x[0] for x in found} == {3} and len(found) == 2 and {x[2] for x in found} == {2}
    assert {tuple(x) for x in same_places(people(spark, rows)).collect()} == {(4, 5)}
    # an unmarked town is told from the street by what the region knows
    towns = [(1, None, None, None, "3 Oakley Hillbrook, NY 12345", None), (2, None, None, None, "3 Oakley Hillbrook NY 12345", None), (3, None, None, None, "5 Elmway St, Hillbrook, NY 12345", None)]
    assert {tuple(x) for x in same_places(people(spark, towns)).collect()} == {(1, 2)}


def test_names_meet_in_a_context_of_any_size(spark):
    pair = [(1, "William Lee", "512-555-0182", None, None, None), (2, "Billy Lee", "512-555-0182", None, None, None), (3, "Maria Ostravanova Lunt", "512-555-0182", None, None, None), (4, "Maria OstravanovaLunt", "512-555-0182", None, None, None), (5, "Petrobelinka Jan", "512-555-0182", None, None, None), (6, "Petrubelinke Jan", "512-555-0182", None, None, None)]
    rng = random.Random(3)
    crowd = [(100 + i, "".join(rng.choice("bdfgkmprtvz") + rng.choice("aeiou") for _ in range(4)).title() + " " + "".join(rng.choice("bdfgkmprtvz") + rng.choice("aeiou") for _ in range(5)).title(), "512-555-0182", None, None, None) for i in range(60)]
    want = {(1, 2), (3, 4), (5, 6)}
    assert {tuple(x) for x in same_names(people(spark, pair)).collect()} == want
    assert want <= {tuple(x) for x in same_names(people(spark, pair + crowd)).collect()}
    members = {x.row_id: (x.group_id, x.spellings) for x in name_members(people(spark, pair)).collect()}
    assert members[1] == members[2] == (1, 2) and set(members) == {1, 2, 3, 4, 5, 6}


def test_the_search_by_tokens_finds_what_the_outright_one_does(spark):
    forms = [f for x in ("Ann Ashlanessan", "Ann B Ashlunessen", "Bobby Lidde", "Robert Lidde", "Mary Anna S. Ostravan", "Maryanna Ostravan", "Jan Vorst", "J Vorst", "Christopher Lo", "Chris Lo", "Farid Fosurd", "F. Fpsurd", "Oakes View Repair", "Oakesview Repair") if (f := parse.name_form(x))]
    spelt = spark.createDataFrame([("k", f, 1 + i % 3, 2) for i, f in enumerate(forms)], "key string, form string, n long, seen long")
    one = {tuple(x) for x in attribute(spelt, Scratch(spark), outright=40).collect()}
    assert one == {tuple(x) for x in attribute(spelt, Scratch(spark), outright=2).collect()} and len(one) >= 5


def test_short_names_and_foreign_numbers(spark):
    assert parse.full_names("bob") & parse.full_names("robert") and parse.full_names("oak") == frozenset()
    assert parse.phone10("+44 20 7946 0958") == "+442079460958" and parse.phone10("555-0182") == "5550182" and parse.phone10("12345") is None
    values = ["+44 20 7946 0958", "0044 20 7946 0958", "555-0182", "(512) 555-0182 ext. 4", "1-512-555-0182", "999 999 9999", "n/a", "", None, "12345678", "tel 512.555.0182 / w"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", parse.phone_column(__import__("pyspark.sql.functions", fromlist=["col"]).col("v")).alias("p")).collect()
    assert [x.p for x in got] == [parse.phone10(v) for v in values]
    zips = ["6152", "06152-1234", "061521234", "2152.0", "00000", "12", "x", None, " 12345 "]
    got = spark.createDataFrame([(v,) for v in zips], "v string").select(parse.zip_column(__import__("pyspark.sql.functions", fromlist=["col"]).col("v")).alias("p")).collect()
    assert [x.p for x in got] == [parse.zip5(v) for v in zips]


def _cells(spark, rows):
    t = lambda d: None if d is None else dt.datetime(2024, 1, d)
    ids = ";".join(str(r[0]) for r in rows)
    people_rows = [(i, ds, None, ph, None, None, t(at), ids if k == 0 else None) for k, (i, ds, ph, at) in enumerate(rows)]
    df = spark.createDataFrame(people_rows, "row_id long, dataset_id string, name string, phone string, address string, zip string, updated_at timestamp, source_row_ids string")
    over = spark.createDataFrame([], "override_id long, column_name string, row_id long, created_at timestamp, revoked_at timestamp")
    trust = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "dataset_id string, trust_rank int")
    return {x.column_name: (x.row_id, x.basis) for x in survivors(df, over, trust).collect()}


def test_certain_order_meets_a_missing_time(spark):
    # row 2 is later and more trusted than row 1; row 3 has no time and cannot change that
    got = _cells(spark, [(1, "a", "(512) 555-0001", 1), (2, "b", "5125550002", 2), (3, "a", "512-555-0003", None)])
    assert got["phone"][0] == 2
    assert _cells(spark, [(1, "a", "(512) 555-0001", 1), (2, "b", "5125550002", 2)])["phone"] == (2, "dominant")
    assert _cells(spark, [(1, "a", "(512) 555-0001", None), (2, "a", "5125550002", None)])["phone"] == (1, "tie")


def test_learned_precedence_decides_where_times_are_missing(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = []
    for g in range(40):  # bare digits come first, brackets later
        rows += [(10 * g + 1, "a", f"512555{g:04d}", t(1), f"{10 * g + 1};{10 * g + 2}"), (10 * g + 2, "b", f"(512) 555-{g:04d}", t(2), None)]
    rows += [(9001, "a", "5125559001", None, "9001;9002"), (9002, "a", "(512) 555-9002", None, None)]
    df = spark.createDataFrame([(i, ds, None, ph, None, None, at, ids) for i, ds, ph, at, ids in rows], "row_id long, dataset_id string, name string, phone string, address string, zip string, updated_at timestamp, source_row_ids string")
    over = spark.createDataFrame([], "override_id long, column_name string, row_id long, created_at timestamp, revoked_at timestamp")
    got = {(x.group_id, x.column_name): (x.row_id, x.basis) for x in survivors(df, over, spark.createDataFrame([("a", 2), ("b", 1)], "dataset_id string, trust_rank int")).collect()}
    assert got[9001, "phone"] == (9002, "currency")


def test_cycles_are_cut():
    assert acyclic([("f", "a", "b"), ("f", "b", "c"), ("f", "c", "a"), ("f", "c", "d"), ("g", "a", "b")]) == [("f", "c", "d"), ("g", "a", "b")]


def test_long_quotations_and_brackets_stay_whole():
    model = Model([])
    for n in (5, 30, 300):
        inner = " ".join("It was so. We saw it!" for _ in range(n))
        text = f"They said ({inner}) and left. Then it ended."
        assert [text[a:b] for a, b in model.units(text, "en")] == [f"They said ({inner}) and left.", "Then it ended."]
    text = "A stray ( mark. " * 400
    assert len(model.units(text, "en")) == 400


def test_each_capacity_binds_and_shards_are_packed_again(spark):
    sizes = np.array([60, 50, 40, 30, 20, 10, 10, 10, 5, 5, 5, 5])
    free, _ = best_fit(sizes, 100, 12, 1e9)
    slots, _ = best_fit(sizes, 100, 3, 1e9)
    attention, _ = best_fit(sizes, 100, 12, 4000.0)
    assert np.bincount(free, sizes).max() <= 100 and np.bincount(slots).max() <= 3 < np.bincount(free).max()
    cost = np.bincount(attention, sizes.astype(float) ** 2)
    assert (cost[np.bincount(attention) > 1] <= 4000).all() and (np.bincount(free, sizes.astype(float) ** 2)[np.bincount(free) > 1] > 4000).any()
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 300, 3000))], "doc_id long, n_tokens int")
    wins = spark.createDataFrame([(1, 256), (2, 4096)], "window_id int, capacity_tokens int")
    whole, sharded = (fill_containers(docs, wins, per_shard=k).cache() for k in (6000, 200))
    for out in (whole, sharded):
        assert out.groupBy("window_id").sum("n_tokens").distinct().count() in (1, 2) and out.count() == out.select("window_id", "doc_id", "piece").distinct().count()
    a, b = ({x.window_id: x.containers for x in fill_report(o, wins).collect()} for o in (whole, sharded))
    assert all(b[w] <= a[w] * 1.02 + 2 for w in a)


def test_slips_meet_whatever_is_close(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)

    def typed(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])

    pairs = []
    for n in range(3, 22):
        for _ in range(60):
            w = "".join(rng.choice("abcdefgh") for _ in range(n))
            v = typed(w) if n < 8 or rng.random() < 0.3 else typed(typed(w))
            if v and parse.close(w, v):
                pairs.append((w, v))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert len(pairs) > 800 and df.where(~F.arrays_overlap(parse.slips(F.col("a")), parse.slips(F.col("b")))).count() == 0


def test_chance_of_a_slip_counts_every_pair(spark):
    from rowloom.llm.linkage import chance_levels, slipped_regions

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(5)
    code = lambda: "".join(rng.choice("0123") for _ in range(5))
    rows = [(i, i % 3 == 0, rng.choice([None, f"p{rng.randrange(9)}"]), rng.choice([None, f"a{rng.randrange(9)}"]), rng.choice([None, code(), code(), "01230"]), rng.choice([None, "7", "8", "9"])) for i in range(400)]
    known = spark.createDataFrame([(i, f"p||ann oak{z}", ph, pl, z, n) for i, _, ph, pl, z, n in rows], "id long, form string, phone string, place string, zip string, number string")
    side = spark.createDataFrame([(i, l) for i, l, *_ in rows], "id long, l boolean")
    met = [(x, y) for x in rows if x[1] for y in rows if not y[1]]
    both = [(x[4], y[4]) for x, y in met if x[4] and y[4]]
    slip = sum(a != b and edits(a, b) <= 2 for a, b in both)
    assert slipped_regions(known.join(side, "id")) == slip and slip > sum(a != b and sum(c != d for c, d in zip(a, b)) <= 2 for a, b in both)
    chance = chance_levels(known, side, 50_000)
    assert chance["zip"][1] == (slip + 0.5) / (len(both) + 1.0) and chance["zip"][2] == (sum(a == b for a, b in both) + 0.5) / (len(both) + 1.0)
    phones = [(x[2], y[2]) for x, y in met if x[2] and y[2]]
    assert chance["phone"][1] == (sum(a == b for a, b in phones) + 0.5) / (len(phones) + 1.0)


def test_tokens_meet_whatever_is_close(spark):
    from rowloom.llm.names import near_tokens

    rng = random.Random(2)
    words = set()
    for n in range(3, 15):
        for _ in range(12):
            v = "".join(rng.choice("abcdé") for _ in range(n))
            for _ in range(4):
                words.add(v)
                k = rng.randrange(len(v))
                v = rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice("abc") + v[k:], v[:k] + rng.choice("abc") + v[k + 1 :], v[:k] + v[k + 1 : k + 2] + v[k : k + 1] + v[k + 2 :]])
    tokens = sorted(words) + [f"+{w}" for w in sorted(words) if len(w) > 9] + ["#ann", "#anna"]
    left, right = tokens[::2], tokens[::3]
    bare = lambda t: t.lstrip("+")
    want = {(t, t) for t in set(left) & set(right) if t[0] != "+"}
    want |= {(t, o) for t in left for o in right if t != o and "#" not in t + o and not t[0] == o[0] == "+" and min(len(bare(t)), len(bare(o))) >= 3 and parse.close(bare(t), bare(o))}
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "token string")
    got = [tuple(x) for x in near_tokens(frame(left), frame(right), Scratch(spark)).collect()]
    assert set(got) == want and len(got) == len(want) > 500


def test_the_typo_search_writes_no_lost_letters_out(spark):
    from rowloom.llm.names import near_tokens

    class Counting(Scratch):
        rows = 0

        def cut(self, df, **how):
            back = super().cut(df, **how)
            self.rows = max(self.rows, back.count())
            return back

    rng = random.Random(4)
    frame = spark.createDataFrame([("".join(rng.choice("abcdefgh") for _ in range(12)),) for _ in range(300)], "token string")
    scratch = Counting(spark)
    near_tokens(frame, frame, scratch).count()
    # 12 letters have 79 forms with up to two lost
    assert scratch.rows <= 600


def test_namesakes_by_given_name_are_not_compared_and_spellings_are(spark):
    from rowloom.llm.linkage import _pairs

    rng = random.Random(9)
    last = ["t" + "".join(rng.choice("aeiou") + rng.choice("bdfgkmprv") for _ in range(3)) + "n" for _ in range(30)]
    typed = lambda w: w[:3] + w[4:]
    left, right = [f"p||ken b {w}" for w in last], [f"p||kenneth b {typed(w)}" for w in last]
    # other ways to write one name: initial, words written as one, a typo in the name that a short form stands for, two typos at the ends
    left += ["p||ivan torkisenda", "p||maryanna lee", "p||robert halt", "p||zoe xkelnudilix", "o||plumview auto repair"]
    right += ["p||i torkisenda", "p||mary anna lee", "p||bobbie halt", "p||zoe kelnudili", "o||plumveiw auto repair"]
    rows = [(i, f, True) for i, f in enumerate(left)] + [(1000 + i, f, False) for i, f in enumerate(right)]
    known = spark.createDataFrame([(i, f, None, "12345", None, None) for i, f, _ in rows], "id long, form string, phone string, zip string, place string, number string")
    got = {tuple(x) for x in _pairs(known, spark.createDataFrame([(i, l) for i, _, l in rows], "id long, l boolean"), Scratch(spark)).collect()}
    want = {(i, 1000 + j) for i, a in enumerate(left) for j, b in enumerate(right) if parse.name_ops(min(a, b), max(a, b)) is not None}
    # all 900 pairs of the first thirty share a given name, an initial and the first letter of the last word
    assert {(i, 1000 + i) for i in range(30)} <= want <= got and len(got) < 400


def test_names_and_addresses_are_parsed_once(spark):
    from rowloom.llm.names import contacts
    from rowloom.llm.places import parts_of

    def evaluations(df):
        return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")

    rows = spark.createDataFrame([(1, "Ann Lee", None, None, "12 Elm St", "12345", None)], "id long, name string, phone string, email string, address string, zip string, town string")
    assert evaluations(parts_of(rows)) == 1
    named = rows.select("id", parse.name_column(rows["name"]).alias("form")).where("form IS NOT NULL")
    assert evaluations(named) == 1 and [x.form for x in named.collect()] == ["p||ann lee"]
    assert [x.form for x in contacts(rows, Scratch(spark)).collect()] == ["p||ann lee"]


def test_a_worker_holds_a_bounded_part_of_its_rows():
    import tracemalloc

    import pandas as pd

    from rowloom.llm.typos import meeting

    def held(work):
        tracemalloc.start()
        result = work()
        now, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return result, now / 1e6, peak / 1e6

    parse.address_parts.cache_clear()
    assert held(lambda: [parse.address_parts(f"{k} Elm Street, Springfield", "12345") for k in range(1, 30_000)].clear())[1] < 6
    forms = pd.Series([f"p||ann{k % 97} b{k}x" for k in range(6_000)])
    parts = list(parse.tokens_of.func(iter([(forms, pd.Series([True] * len(forms)))])))
    assert max(map(len, parts)) <= 1_000 and [r[0]["token"] for s in parts for r in s] == [f"ann{k % 97}" for k in range(6_000)]
    # numbers of a bucket: every second left word has one partner
    n = 1_000_000
    numbers = np.arange(n, dtype=np.uint32) // 2
    ids = np.arange(n) * 8 + np.arange(n) % 2 + 1
    pairs, _, peak = held(lambda: sum(int((b - a == 9).sum()) for a, b in meeting(numbers, ids)))
    assert pairs == n // 2 and peak < 40

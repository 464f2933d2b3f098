import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.functions import normalize as nz
from rowloom.functions import similarity as sim
from rowloom.functions import text as t
from rowloom.operators import likelihood as lh
from rowloom.operators import matching as m
from rowloom.operators import review
from rowloom.operators.components import connected
from rowloom.runtime import Scratch

PEOPLE = {"Name": "name", "Phone": "phone", "Email": "email", "Address": "address", "City": "city", "Zip": "postal_code"}


def rows(spark, data, mapping=PEOPLE, person=True):
    cols = list(mapping)
    df = spark.createDataFrame([(f"r{k}", *[d.get(c) for c in cols]) for k, d in enumerate(data)], "row_id string, " + ", ".join(f"`{c}` string" for c in cols))
    return nz.normalized(df, "row_id", mapping)


def decide_all(spark, cases, mapping=PEOPLE, person=True, strictness="conservative"):
    """Decision of each pair of rows, all in one run: the rows of a case are 2k and 2k+1."""
    r = rows(spark, [x for pair in cases for x in pair], mapping)
    pairs = spark.createDataFrame([(f"r{2 * k}", f"r{2 * k + 1}") for k in range(len(cases))], "left string, right string")
    got = {x.left: x for x in m.decide(m.compare(pairs, r, person=person), strictness).collect()}
    return [got[f"r{2 * k}"] for k in range(len(cases))]


def test_normal_forms(spark):
    df = spark.createDataFrame([("1", "Smith, John Q. Jr", "12 North Oak Street Apt 4", "Café ß Ｍain"), ("2", "Dr. Ann van der Berg", "Unit 5", None), ("3", "Madonna", "", "x"), ("4", None, None, "")], "id string, name string, address string, city string")
    n = {x.row_id: x.n for x in nz.normalized(df, "id", {"name": "name", "address": "address", "city": "city"}).collect()}
    assert (n["1"].person.given, n["1"].person.surname) == (["john", "q"], "smith") and n["1"].city == "café ss main"
    assert n["1"].address.asDict() == {"house_number": "12", "street": "n oak st", "unit": "4", "full": "12 n oak st 4"}
    assert (n["2"].person.given, n["2"].person.surname) == (["ann"], "berg") and n["3"].person is None and n["4"].name is None and n["4"].address is None
    parts = spark.createDataFrame([("1", "Ann", "Lee", "77", "Main Street", "3")], "id string, f string, l string, h string, s string, u string")
    p = nz.normalized(parts, "id", {"f": "first_name", "l": "last_name", "h": "house_number", "s": "street", "u": "unit"}).first().n
    assert p.name == "ann lee" and p.address.house_number == "77" and p.address.unit == "3" and p.person.surname == "lee"


def test_decisions_of_people(spark):
    base = {"Name": "Robert Harris", "Phone": "(512) 555-0182", "Address": "12 Oak St", "Zip": "78701"}
    cases = [
        (base, {**base, "Name": "Bob Harris"}), (base, {**base, "Name": "Mary Harris"}), ({**base, "Email": "x@a.example"}, {**base, "Name": "Mary Harris", "Email": "x@a.example"}), (base, {**base, "Address": "14 Oak St"}), (base, {"Name": "Harris Robert", "Phone": "512 555 0182"}),
        ({"Phone": "512-555-0182", "Zip": "78701"}, {"Phone": "512.555.0182", "Zip": "78701"}), ({"Name": "Ann Lee"}, {"Phone": "512-555-0199"}), ({"Name": "Ann Lee", "City": "Austin"}, {"Name": "Ann Lea", "City": "Austin"}),
    ]
    got = decide_all(spark, cases)
    assert [x.decision for x in got] == ["match", "non_match", "possible_match", "non_match", "match", "match", "non_match", "possible_match"]
    assert got[1].reason == "Cannot auto-merge: Different first names" and "house number" in got[3].reason and got[6].reason == "No comparable fields"
    ids = decide_all(spark, [({"APN": "7", "Phone": "512-555-0182"}, {"APN": "8", "Phone": "512-555-0182"}), ({"APN": "7 "}, {"APN": "7"})], {"APN": "identifier", "Phone": "phone"}, person=False)
    assert [x.decision for x in ids] == ["non_match", "match"]


def test_blocks_and_oversized(spark):
    r = rows(spark, [{"Phone": "512-555-0182", "Name": f"N{i} X"} for i in range(6)])
    keys = m.block_keys(r)
    assert m.candidates(keys, 5).count() == 0 and m.oversized(keys, 5).first()["size"] == 6 and m.candidates(keys, 6).count() == 15
    # surname blocks need a row without contacts
    r = rows(spark, [{"Name": "Robert Haris", "City": "Austin"}, {"Name": "Bob Harris", "City": "Austin", "Phone": "512-555-0182"}, {"Name": "Rob Harris", "City": "Austin", "Phone": "512-555-0199"}])
    assert {(x.left, x.right) for x in m.candidates(m.block_keys(r, person=True)).collect()} == {("r0", "r1"), ("r0", "r2")}


def _nodes(n, houses=None, locks=None):
    return [(f"r{i}", (houses or {}).get(i), [], (locks or {}).get(i), None, None) for i in range(n)]


def test_bridges_constraints_and_locks():
    match = lambda a, b, s=1.0: ("match", f"r{a}", f"r{b}", s, f"d{a}{b}", "")
    said = lambda kind, a, b: (kind, f"r{a}", f"r{b}", 1.0, None, "")
    groups, bridges, _ = m.merge_component(_nodes(4), list([match(0, 1), match(2, 3), match(1, 2, 0.96)]), False)
    assert sorted(map(sorted, (g.rows for g in groups))) == [["r0", "r1"], ["r2", "r3"]] and bridges == ["d12"]
    groups, _, refused = m.merge_component(_nodes(3), list([match(0, 1), match(1, 2, 0.97), said("must_not", 0, 2)]), False)
    assert sorted(len(g.rows) for g in groups) == [1, 2] and refused == 1
    groups, _, _ = m.merge_component(_nodes(3, locks={0: "a", 1: "a"}), list([match(1, 2), said("lock", 0, 1)]), False)
    assert sorted(len(g.rows) for g in groups) == [1, 2]
    groups, _, _ = m.merge_component(_nodes(3, houses={0: "1", 2: "2"}), list([match(0, 1), match(1, 2, 0.97)]), False)
    assert all(len(g.houses) <= 1 for g in groups)


def test_components_do_not_change_the_merging(spark):
    rng = random.Random(4)
    n = 60
    links = [("match", *sorted((f"r{rng.randrange(n)}", f"r{rng.randrange(n)}")), round(rng.random(), 2), f"d{k}", "") for k in range(55)]
    links = [x for x in links if x[1] != x[2]]
    houses = {i: str(rng.randrange(3)) for i in range(0, n, 4)}
    whole, bridges, _ = m.merge_component(_nodes(n, houses), list(links), False)
    r = spark.createDataFrame([(f"r{i}", houses.get(i, "")) for i in range(n)], "row_id string, h string")
    no = F.lit(None).cast("string")
    r = r.select("row_id", F.struct(F.create_map().cast("map<string,string>").alias("identifier"), F.struct(F.col("h").alias("house_number")).alias("address"), F.struct(F.array().cast("array<string>").alias("given"), no.alias("surname")).alias("person")).alias("n"))
    d = spark.createDataFrame([(a, b, s, k, "match") for _, a, b, s, k, _ in links], "left string, right string, score double, decision_id string, decision string")
    clusters, rejected = m.cluster(r, d)
    got = {}
    for x in clusters.collect():
        got.setdefault(x.cluster_id, set()).add(x.row_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g.rows) for g in whole) and {x.decision_id for x in rejected.collect()} == set(bridges)


def test_components(spark):
    links = [(1, 2), (2, 3), (None, 4), (5, 5), (9, 8), (8, 7), *[(100, 100 + i) for i in range(1, 30)], *[(200 + i, 201 + i) for i in range(25)]]
    graph = spark.createDataFrame(links, "a long, b long")
    got, again = ({x.id: x.group for x in connected(graph, "a", "b", Scratch(spark), in_task=k).collect()} for k in (0, 1000))
    assert got == again == {**{i: 1 for i in (1, 2, 3)}, **{i: 7 for i in (7, 8, 9)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(26)}}


def test_canonical_record(spark):
    data = spark.createDataFrame([("a", 1, "s1", "Ann", "", "x"), ("b", 2, "s1", "Anna", "512", None), ("c", 3, "s2", "", "513", "y"), ("d", 4, "s2", "Z", None, None)], "row_id string, row_number int, source string, name string, phone string, note string")
    clusters = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c1"), ("d", "c2")], "row_id string, cluster_id string")
    ranked = m.survivor_rank(data, clusters, ["name", "phone", "note"], trust=["s2", "s1"])
    got = {(x.cluster_id, x.column_name): (x.value, x.row_id, x.rule, x.conflicts) for x in m.canonicalize(ranked, ["name", "phone", "note"], spark.createDataFrame([("a", "phone")], "row_id string, column_name string"), {"s1": {"phone": "phone"}, "s2": {"phone": "phone", "name": "ignore"}}).collect()}
    assert got["c1", "name"] == ("Ann", "a", "fill_from_member", 2) and got["c1", "note"] == ("y", "c", "survivor", 2)
    assert got["c1", "phone"] == ("", "a", "reviewer_choice", 2) and got["c1", "canonical.phone"] == ("513", "c", "role_from_survivor", 0)
    assert got["c2", "phone"] == ("", None, None, 0) and got["c2", "name"][2] == "survivor" and ("c2", "canonical.phone") not in got


def test_validation():
    assert m.validate_request({"a": {"x": "phone"}, "b": {"y": "phone", "z": "name"}})["max_block_size"] == 200
    for bad in ({}, {"a": {"x": "nonsense"}}, {"a": {"x": "name", "y": "name"}}, {"a": {"x": "city"}}, {"a": {"x": "phone"}, "b": {"y": "name"}}):
        with pytest.raises(ValueError):
            m.validate_request(bad)
    assert m.config_hash({"a": 1, "preview_size": 5}) == m.config_hash({"preview_size": 9, "a": 1}) != m.config_hash({"a": 2})


def test_likelihood_prefers_rare_values(spark):
    common = [{"Name": f"John Smith{'' if i else ''}", "Phone": f"512-555-{2000 + i}", "City": "Austin"} for i in range(12)]
    rare = [{"Name": "Zebulon Quixworth", "Phone": "512-555-0001", "City": "Austin"}, {"Name": "Zebulon Quixworth", "Phone": "512-555-0002", "City": "Austin"}]
    r = rows(spark, common + rare)
    pairs = spark.createDataFrame([("r0", "r1"), ("r12", "r13")], "left string, right string")
    d = m.decide(m.compare(pairs, r, person=True))
    got = {x.left: x.likelihood for x in lh.likelihood(d, r, person=True).join(d.select("decision_id", "left"), "decision_id").collect()}
    assert got["r12"] > got["r0"]
    one = r.where("row_id = 'r0'")
    assert lh.likelihood(d, one, person=True).where("likelihood IS NOT NULL").count() == 0


def test_ranking():
    labelled = [([1.0, i / 30, float(i > 14)], int(i > 14)) for i in range(30)]
    model = lh.train(labelled)
    assert model["evaluation"]["holdout_size"] == 7 and model["training_hash"] == lh.train(labelled[::-1])["training_hash"] and model["weights"][2] > 0
    with pytest.raises(ValueError):
        lh.train(labelled[:5])


def test_review_log(spark):
    pair = {"decision_id": "d1", "left": "a", "right": "b", "review_version": 0, "strengths": ["strong"]}
    out = review.submit(pair, "merge", 0, "x1", "now", {"name": "b"})
    assert out["constraints"] == [("x1", "a", "b", "must_link", "now", None)] and out["overrides"][0][2] == "b"
    for bad in (dict(decision={**pair, "strengths": ["guard"]}), dict(action="keep_separate"), dict(values={"name": "zz"}), dict(action="other")):
        with pytest.raises(ValueError):
            review.submit(bad.get("decision", pair), bad.get("action", "merge"), 0, "x", "now", bad.get("values", {"name": "a"}))
    with pytest.raises(review.ReviewConflict):
        review.submit(pair, "merge", 1, "x", "now")
    log = spark.createDataFrame([("x1", "b1", "a", "b", "must_link", None), ("x2", "b1", "c", "d", "must_link", None), ("x3", None, "e", "f", "must_link", None)], "action_id string, batch_id string, left string, right string, kind string, revoked_at timestamp")
    at = F.lit("2024-01-01").cast("timestamp")
    assert review.in_effect(review.undo(log, at, batch_id="b1")).count() == 1 and review.in_effect(review.undo(log, at, action_id="x3")).count() == 2
    d = spark.createDataFrame([("d1", "b", "a", "possible_match", 0.5, 0.995), ("d2", "x", "y", "possible_match", 0.9, None)], "decision_id string, left string, right string, decision string, score double, likelihood double")
    assert [x.decision_id for x in review.pending(d, log).collect()] == ["d2"] and [x.decision_id for x in review.queue(d).collect()] == ["d1", "d2"] and [x.decision_id for x in review.queue(d, "score", 1, 5).collect()] == ["d1"]
    assert review.split(spark.createDataFrame([("a",), ("b",), ("c",)], "row_id string"), ["b"]).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcde ", max_size=12), st.text(alphabet="abcde ", max_size=12))
def test_similarities_against_plain_versions(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    assert sim.common_length(a, b) == lcs(a, b) and sim.indel_ratio(a, b) == sim.indel_ratio(b, a) and 0 <= sim.jaro_winkler(a, b) <= 1

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    assert sim.within_one(a, b) == (edits(a, b) <= 1)


def test_keys_fold_accents(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one(t.fingerprint, "Café  Müller") == "cafe muller" and one(t.fingerprint, "O'Brien, Ann") == "ann obrien" and one(t.company_key, "The AT&T Company, Inc.") == "at&t"
    assert one(t.tidy, "éa  b​ ") == "éa b" and one(t.ascii_fold, "ﬁn naïve 中") == "fin naive " and one(t.email, "a.b+x@googlemail.com") == "ab@gmail.com" and one(t.phone, "+44 20 7946 0958") == "+442079460958"

import datetime as dt
import random
import textwrap

import numpy as np
import pytest

from rowloom.llm import parse
from rowloom.llm.components import group_linked
from rowloom.llm.linkage import expectation_maximisation, link_sources, matches
from rowloom.llm.names import same_names
from rowloom.llm.packing import best_fit, fill_containers
from rowloom.llm.places import same_places
from rowloom.llm.residue import residue
from rowloom.llm.sentences import Model, blocks, sentence_units
from rowloom.llm.survivors import survivors
from rowloom.llm.tokens import encode_corpus

PEOPLE = "row_id long, name string, phone string, email string, address string, zip string, place string, id string"


def _groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(1, 1), (None, 2), (3, None)],
        [(0, i) for i in range(1, 50)],
        [(i, i + 1) for i in range(40)],
        [(i, (i + 1) % 13) for i in range(13)],
        [(a, b) for a in range(5) for b in range(a)] + [(4, 9), (9, 10), (10, 11)] + [(20, 21), (21, 20), (20, 21)],
    ],
)
def test_groups_against_union_find(spark, links):
    got = group_linked(spark.createDataFrame(links, "a long, b long"), "a", "b")
    assert {tuple(x) for x in got.collect()} == set(_groups(links).items())


def test_groups_of_random_graphs(spark):
    rng = random.Random(5)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(130)]
    assert dict(map(tuple, group_linked(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())) == _groups(links)


def test_tokens_equal_the_public_encoder(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", None, "<|endoftext|>", "a" * 3000, "naïve  \n\n 中文 ไทย 🏠🏽", *["".join(rng.choice("abetins ก中.0\n") for _ in range(rng.randrange(400))) for _ in range(40)]]
    got = encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.ids for x in got} == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_keeps_every_constraint(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 300)
    bins, _ = best_fit(sizes, 100, 4, 100.0 * 100)
    assert np.bincount(bins, sizes).max() <= 100 and np.bincount(bins).max() <= 4
    assert len(np.unique(bins)) <= 1.1 * max(sizes.sum() / 100, len(sizes) / 4) + 2
    docs = spark.createDataFrame([(1, 250), (2, 40), (3, 0), (4, None), (5, 100), (6, 40)], "doc_id long, n_tokens int")
    out = fill_containers(docs, spark.createDataFrame([(1, 100), (1, 100), (2, None)], "window_id int, capacity_tokens int")).collect()
    assert sorted((x.doc_id, x.piece, x.n_tokens) for x in out) == [(1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 40), (3, 0, 0), (4, 0, 0), (5, 0, 100), (6, 0, 40)]
    assert {x.doc_id for x in out if x.container is None} == {3, 4}


def test_survivors(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, "a", "Ann", "555-1234", "x", "12111", t(1), "1;2; 2"), (2, "b", "Ann Lee", "n/a", "1 Oak St", None, t(2), None), (3, "a", "Bo", "512-555-0182", "", "22222", t(3), "3;4"), (4, "b", "Bob", "512-555-0183", None, "33333", t(1), "4;3;"), (5, "a", "Z", None, None, None, None, "5"),
    ]
    people = spark.createDataFrame(rows, "row_id long, dataset_id string, name string, phone string, address string, zip string, updated_at timestamp, source_row_ids string")
    over = spark.createDataFrame([(1, " NAME", 3, t(1), None), (2, "name", 4, t(2), None), (3, "zip", 3, t(1), t(2)), (4, "zip", 77, t(1), None)], "override_id long, column_name string, row_id long, created_at timestamp, revoked_at timestamp")
    trust = spark.createDataFrame([("a", 2), ("b", 1)], "dataset_id string, trust_rank int")
    got = {(x.group_id, x.column_name): (x.row_id, x.basis) for x in survivors(people, over, trust).collect()}
    assert got[1, "name"] == (2, "dominant") and got[1, "phone"] == (1, "dominant") and got[1, "address"] == (2, "dominant") and got[1, "zip"] == (1, "dominant")
    assert got[3, "name"] == (4, "override") and got[3, "phone"][1] not in ("dominant", "override") and (3, "address") not in got


def test_residue(spark):
    rec = "struct<title:string,description:string,price:string,author:string,source_url:string>"
    ok = ("Oak desk", "The manual shows how a mail merge fills {{first_name}}.", "9.50", None, None)
    records = [ok, ("Error 404", None, None, None, None), ("Oak desk", "Made in ${city} since 1990.", None, None, None), ("Lorem, the wandering goat", "Fine.", "NaN", None, None), None, ("Access Denied door sign, oak", None, None, None, None)]
    warnings = ["page 3 needed JavaScript; the browser engine read it", "Please enable JavaScript.", None, "", "lorem ipsum dolor"]
    rows = [(1, "https://a.example/x", records, warnings), (1, "https://a.example/x", records, warnings), (2, None, None, [])]
    got = residue(spark.createDataFrame(rows, f"run_id long, source_url string, records array<{rec}>, warnings array<string>")).collect()
    assert {(x.run_id, x.field_name, x.item_pos) for x in got} == {(1, "records", 1), (1, "records", 2), (1, "records", 3), (1, "warnings", 1), (1, "warnings", 4)}


def test_parsers():
    assert parse.address_parts("Apt. 13, 4614 South Larkleham Xing", "74858") == ("74858", "", "4614", "13", "s", "", "larkleham", "crossing", "")
    assert parse.address_parts("9th circle no. 4427, 8th floor", "12009.0")[2:] == ("4427", "f8", "", "", "9th", "circle", "")
    assert parse.address_parts("POB 15, Cedargate, ME 02920")[2] == "box" and parse.address_parts("on file") is None and parse.address_parts(None) is None
    assert parse.zip5("6152") == "06152" and parse.zip5("00000") is None and parse.phone10("1-512-555-0182 x 4") == "5125550182" and parse.phone10("999-999-9999") is None
    assert parse.name_form("Lee, Dr. Ann B. Jr") == "p|jr|ann b lee" and parse.name_form("-") is None
    cost = lambda a, b: parse.name_cost(parse.name_form(a), parse.name_form(b))
    assert cost("Bob Fosadene", "Fosadene, Robert J.") is not None and cost("Ann Fosadene", "Bea Fosadene") is None and cost("Al Fosadene Jr", "Al Fosadene Sr") is None
    assert parse.different_people("p||rosa harbokas", "p||gail harbokas") and not parse.different_people("p||pat ashlaness", "p||patrocia ashlaness")


def _people(spark, rows):
    return spark.createDataFrame([(*r, "p", "i") for r in rows], PEOPLE)


def test_places_and_names(spark):
    rows = [
        (1, "Ann Oakvist", "(512) 555-0182", "ann.oak@x.example", "12 North Larkleham Street", "12345"), (2, "OAKVIST, ANN B.", "512-555-0182", None, "12 N. Larkelham St", "12345-6789"), (3, "Ann Oakvist", None, None, "12 Larkleham", ""),
        (4, "Bea Oakvist", "512-555-0182", None, "14 Larkleham St", "12345"), (5, "Ann Oakvist", "(713) 555-0000", None, "12 Larkleham St Apt 2", "12345"), (6, None, None, None, None, None), (7, "", "n/a", "", "on file", "x"), (1, "Ann Oakvist", "(512) 555-0182", "ann.oak@x.example", "12 North Larkleham Street", "12345"),
    ]
    people = _people(spark, rows)
    assert {tuple(x) for x in same_places(people).collect()} == {(1, 2), (1, 3), (2, 3)}
    got = {tuple(x) for x in same_names(people).collect()}
    assert (1, 2) in got and not any(4 in p or 6 in p or 7 in p for p in got)
    assert same_places(_people(spark, [])).count() == 0 and same_names(_people(spark, [])).count() == 0


def test_linkage(spark):
    chance = [[0.9, 0.05, 0.04, 0.01], [0.99, 0.01]]
    post = expectation_maximisation([((4, 2), 40), ((1, 1), 400), ((4, 0), 3), ((0, 1), 5), ((1, 2), 30)], chance, 1000.0, never=((0, 1),))
    assert post[4, 2] > 0.9 > 0.1 > post[1, 1] and post[1, 2] < 1e-3 and expectation_maximisation([], [[1.0]], 1.0) == {}
    cols = "id long, name string, phone string, email string, address string, zip string, town string"
    left = [(i, f"Given{chr(97 + i)} Sur{chr(97 + i) * 4}", f"512-555-{1000 + i}", None, f"{i + 1} Oak St", "12345", None) for i in range(20)] + [(90, None, None, None, None, None, None)]
    right = [(100 + i, n, p, e, a, z, t) for i, n, p, e, a, z, t in left[:20]]
    linked = link_sources(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols))
    assert {(x.left_id, x.right_id) for x in matches(linked).collect()} == {(i, 100 + i) for i in range(20)}
    assert link_sources(spark.createDataFrame([], cols), spark.createDataFrame(right, cols)).count() == 0


def test_sentences(spark):
    model = Model([("en", "abbr", "dr"), ("en", "abbr", "inc"), ("en", "starts", "the"), ("de", "ordinal", "mal")])
    cut = lambda t, g="en": [t[a:b] for a, b in model.units(t, g)]
    assert cut('He met Dr. Lee of the Acme Inc. The end. He said: "No. Go." to all.') == ["He met Dr. Lee of the Acme Inc.", "The end.", 'He said: "No. Go." to all.']
    assert cut("Heading\n\n- one. two\n- b\n1. c d. e\n  \n") == ["Heading", "- one. two", "- b", "1. c d. e"]
    assert cut("“Leave it.” In short, version 3.4.2 reads a.csv! Why?") == ["“Leave it.”", "In short, version 3.4.2 reads a.csv!", "Why?"]
    assert cut("これは列。「どれ？」と聞かれた。終わり", "ja") == ["これは列。", "「どれ？」と聞かれた。", "終わり"]
    assert cut("") == [] and cut(None) == [] and cut(" \r\n ") == []
    first, second = "The shop was moved by the county in the spring and has been quiet since then, so the row stays.", "It was checked by the clerk who left the office late in the day and sent the list."
    text = textwrap.fill(f"{first} {second}", 60)
    assert [text[a:b].replace("\n", " ") for a, b in model.units(text, "en")] == [first, second] and len(list(blocks(text))) == 1
    docs = spark.createDataFrame([(1, "One. Two.", "en", "x"), (2, None, None, None), (3, "", "de", "y"), (4, "x" * 100_000, "und", "z")], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, sentence_units(docs).collect())) == [(1, 0, 4), (1, 5, 9), (4, 0, 100_000)]
    assert sentence_units(docs.limit(0)).count() == 0


def test_linkage_meets_typos_and_slips(spark):
    cols = "id long, name string, phone string, email string, address string, zip string, town string"
    # regions enough that to share one says something: the posterior alone decides
    letters = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03d}")
    left = [(1000 + i, f"Given{letters(i)} Sur{letters(999 - i) * 2}", f"512-555-{1000 + i}", None, f"{i + 1} Oak St", f"{20000 + i}", None) for i in range(500)]
    right = [(5000 + i, *r[1:]) for i, r in enumerate(left)]
    # a typo in the rarest word, a second surname, a nickname beside two typos, and a slip of the postal code
    left += [(50, "Zofia Xanbisiler", "927-555-5252", None, None, "12345", None), (51, "Imani Rudmunander", None, None, "9 Elm St", "12345", None), (52, "Bob Himonurkas", None, None, None, "12345", None), (54, "Oakesview Inc", None, None, None, "12345", None), (53, "Eddie Jorvevoden", None, None, "928 Brookmardell Ln", "06941", None)]
    right += [(150, "Zoia Xanbisiler", None, None, "77 Elm St", "12345", None), (151, "Imani Rudmunander Vostigen", "512-555-7777", None, None, "12345", None), (152, "Robert Himunurkes", "512-555-7778", None, None, "12345", None), (155, "Oakes Veiw Inc", "512-555-7779", None, None, "12345", None), (153, "Edward Jorvevoden", "940-555-1179", None, "928 Brookmardell Ln", "06914", None), (154, "Nina Xanbisiler", None, None, "78 Elm St", "12345", None)]
    got = {(x.left_id, x.right_id) for x in matches(link_sources(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols))).collect()}
    assert got == {(1000 + i, 5000 + i) for i in range(500)} | {(i, 100 + i) for i in (50, 51, 52, 53)} | {(54, 155)}


def test_name_tokens_are_complete():
    forms = [parse.name_form(x) for x in ("Ann Ashlanessan", "Ann B Ashlunessen", "Bobby Li", "Robert Li", "Mary Anna S. Ostrava", "Maryanna Ostrava", "Jan Vo", "Christopher Maryann Lo", "Mary C. Ann Lo", "Oakes View Repair", "Oakesview Repair", "Nortubern", "Farid Fosurd", "F. Fpsurd")]
    tokens = {f: parse.name_tokens(f) for f in forms}
    met = lambda a, b: any((s == t or parse.close(s.lstrip("+"), t.lstrip("+"))) and (not p or not q or set(p) & set(q)) for s, p in tokens[a] for t, q in tokens[b])
    pairs = [(a, b) for a in forms for b in forms if a < b and (parse.name_cost(a, b) or 9) <= 2.6]
    assert len(pairs) >= 4 and all(met(a, b) for a, b in pairs)
    assert parse.name_tokens("o||insurance") == []


def test_a_mailbox_goes_with_a_person_who_moves(spark):
    mail = "zendimann@x.example"
    rows = [(1, "William N Zendimann", "512-555-0101", mail, None, "36135"), (2, "Bill Zendimann", "713-555-0102", mail, None, "24421"), (3, "William Zendiman", None, mail, None, None)]
    # a default value: namesakes in other regions stay apart
    rows += [(10, "Ann Oakvist", None, "import@x.example", None, "12111"), (11, "Anna Oakvist", None, "import@x.example", None, "22232"), (12, "Bruno Rintath", None, "import@x.example", None, "33343"), (13, "Ann B Oakvist", None, "import@x.example", None, None)]
    assert {tuple(x) for x in same_names(_people(spark, rows)).collect()} == {(1, 2), (1, 3), (2, 3)}

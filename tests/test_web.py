import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rowloom import sinks
from rowloom.functions import transforms as tf
from rowloom.operators import html as h
from rowloom.operators import policy as p
from rowloom.operators import schema as sc
from rowloom.operators import snapshots as sn
from rowloom.sources import files, web
from rowloom.streaming import runs

PAGE = """<html><head><title>T</title><meta name=author content="Ann"></head><body><div class="l x"><article class=pod><h3><a title="One" href="/b/1?x=1#f">One</a></h3><p class=price>$ 1.50</article>
<article class=pod><h3><a title="Two" href="b/2">Two</a></h3><p class=price>$ 2</p></article><article class=pod id=z><h3><a href=b/3>Three</a></h3></article></div>
<script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"7","name":"N","offers":{"price":3}}]}</script><table><tr><th>a<th>a</tr><tr><td>1<td>2</tr></table></body></html>"""


def one(spark, build, value):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0]


def test_selectors_links_and_structured_data():
    fields = [{"name": "t", "selectors": ["h3 > a::attr(title)", "h3 a::text"]}, {"name": "u", "selectors": ["a::attr(href)"], "type": "url"}, {"name": "p", "selectors": ["p.price::text"]}]
    got = h.selector_records(PAGE, "https://e.example/d/p", "div.l article.pod", fields)
    assert [tuple(r.values()) for r in got] == [("One", "https://e.example/b/1?x=1#f", "$ 1.50"), ("Two", "https://e.example/d/b/2", "$ 2"), ("Three", "https://e.example/d/b/3", None)]
    assert h.links(PAGE, "https://e.example/d/p") == ["https://e.example/b/1?x=1", "https://e.example/d/b/2", "https://e.example/d/b/3"]
    tree = h.parse(PAGE)
    assert len(h.select(tree, "article:first-child, #z, [title^=T]")) == 3 and len(h.select(tree, "article + article")) == 2 and h.select(tree, h.css_path(h.select(tree, "#z a")[0]))[0].text() == "Three"
    assert h.structured(PAGE)[0]["data"]["sku"] == "7" and h.repeated_root(PAGE) == "article.pod" and h.table_records(PAGE) == [{"a": "1", "a (2)": "2", "source_table": "1"}]
    assert h.article("<article><h1>H</h1>" + "<p>word word</p>" * 40 + "</article>", "")["title"] == "H" and h.article(PAGE, "") is None
    assert h.json_records('{"a":{"x":[1,2],"y":["p","q"]}}', "a", {"k": "x", "v": "y"}) == [{"k": "1", "v": "p"}, {"k": "2", "v": "q"}] and h.json_path({"a": [{"b": 5}]}, "a.*.b") == 5
    clean, n = h.sanitize('<a onclick="x()" href="?token=abc">l</a><script>1</script><input value="s">')
    assert "onclick" not in clean and "abc" not in clean and "script" not in clean and n["scripts"] == 1 and h.to_markdown("<h1>A</h1><p>b</p>", "") == "# A\n\nb"
    with pytest.raises(ValueError):
        h.select(tree, "a:hover(")


def test_transforms(spark):
    assert one(spark, lambda c: tf.price(c)["amount"], "EUR 1.234,50") == "1234.50" and one(spark, lambda c: tf.price(c)["currency"], "€ 5") == "EUR"
    assert one(spark, tf.date_text, "March 3rd, 2024") == "2024-03-03" and one(spark, tf.date_text, "Tue, 5 Mar 2024 10:00:00 +0000").startswith("2024-03-05T") and one(spark, tf.date_text, "soon") is None
    assert one(spark, tf.registrable_domain, "https://a.b.example.co.uk:80/x") == "example.co.uk" and one(spark, tf.registrable_domain, "10.0.0.1") is None
    assert one(spark, tf.pages_wanted, "1-3, 7,x,2") == [1, 2, 3, 7] and one(spark, tf.western_digits, "١٢٣") == "123" and one(spark, tf.multiplied, "1.5k sqft") == 1500.0
    assert one(spark, tf.log_redaction, "Authorization: Bearer abc.def api_key=12 a@b.example") == "Authorization: [redacted] [redacted] api_key=[redacted] [email]" or "abc.def" not in one(spark, tf.log_redaction, "Authorization: Bearer abc.def")
    assert one(spark, lambda c: tf.absolute_url(c, "https://e.example/a/b"), "../x/./y") == "https://e.example/x/y" and one(spark, lambda c: tf.apply_field(c, {"transforms": ["strip_html", "lowercase"], "type": "string"}), "<b>A &amp; B</b>") == "a & b"
    assert one(spark, lambda c: tf.apply_field(c, {"type": "integer"}), "no") is None and one(spark, tf.roll_date, "12/30/1899") == "" and one(spark, tf.us_date, "December 31, 2024") == "2024-12-31"
    with pytest.raises(ValueError):
        tf.register("trim", F.trim)


def test_files(spark, tmp_path):
    assert files.unique_headers(["a", "", "a", None, "a (2)"]) == ["a", "column_2", "a (2)", "column_4", "a (2) (2)"]
    (tmp_path / "t.csv").write_text('﻿Name,Zip,Name\n"Lee, Ann",02152\n\nBo,1,x\n', encoding="utf-8")
    got = files.import_table(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["Name", "Zip", "Name (2)"] and {tuple(x) for x in got.collect()} == {("Lee, Ann", "02152", ""), ("Bo", "1", "x")}
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1, "b": None}, {"a": "x", "c": {"d": 2}}]))
    assert {tuple(x[k] for k in "abc") for x in files.import_table(spark, str(tmp_path / "t.json")).collect()} == {("1", "", ""), ("x", "", '{"d":"2"}')}
    (tmp_path / "t.xml").write_text('<r xmlns:n="u"><n:i k="1"><b>x</b><b>y</b><c><d>z</d></c></n:i><n:i k="2"/></r>')
    assert [{k: v for k, v in r.items()} for r in files.xml_rows((tmp_path / "t.xml").read_bytes())][0] == {"@k": "1", "b": "x, y", "c.d": "z"}
    with pytest.raises(ValueError):
        files.xml_rows(b"<!DOCTYPE x><x/>")
    book = sinks.workbook({"S": (["a", "b"], [["x", 1], ["", 2.5]])})
    assert files.xlsx_rows(book) == [{"a": "x", "b": "1"}, {"a": "", "b": "2.5"}]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.xlsx").write_bytes(book)
    (tmp_path / "d" / "b.jsonl.gz").write_bytes(gzip.compress(b'{"b": 7}\n{"e": true}\n'))
    wide = files.widen(files.read_documents(spark, str(tmp_path / "d")))
    assert wide.columns == ["path", "row_number", "a", "b", "e"] and {(x.a, x.b, x.e) for x in wide.collect()} == {("x", "1", ""), ("", "2.5", ""), ("", "7", ""), ("", "", "true")}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w xmlns:w="u"><w:tbl><w:tr><w:tc><w:t>h</w:t></w:tc></w:tr><w:tr><w:tc><w:t>v</w:t></w:tc></w:tr></w:tbl></w>')
    assert files.docx_rows(out.getvalue()) == [{"h": "v", "source_table": "1", "source_row": "1"}]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../t.csv", "a\n1\n")
    with pytest.raises(ValueError):
        files.rows_of("x.zip", bad.getvalue())
    (tmp_path / "roll.txt").write_bytes("a\tb\tc\n1 \té\tz\nshort\n".encode("cp1252"))
    assert [tuple(x) for x in files.read_roll(spark, str(tmp_path / "roll.txt"), ["c", "b"]).collect()] == [("z", "é")]


def test_web_documents():
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="/x"/><id>i</id><author><name>N</name></author><category term="c"/></entry></feed>'
    assert web.feed_entries(atom, "https://e.example/f")[0] == {"title": "A", "link": "https://e.example/x", "id": "i", "published": None, "author": "N", "summary": None, "categories": "c"}
    assert web.sitemap_entries(gzip.compress(b"<sitemapindex><sitemap><loc>u</loc></sitemap></sitemapindex>")) == [{"kind": "map", "loc": "u", "lastmod": None}]
    oai = b"<o><record><header status='deleted'><identifier>1</identifier></header></record><record><header><identifier>2</identifier></header><metadata><d><t>a</t><t>b</t></d></metadata></record><resumptionToken>k</resumptionToken></o>"
    assert [(r["identifier"], r["status"], r["fields"], r["token"]) for r in web.repository_records(oai)] == [("1", "deleted", {}, "k"), ("2", None, {"t": "a; b"}, "k")]
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>"
    warc = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://e.example/\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    assert list(web.warc_records(gzip.compress(warc))) == [("response", "https://e.example/", 200, b"<html>")]
    assert [web.sniff(x) for x in (b"%PDF-1", b'{"a":1}\n{"a":2}\n', b"[1]", b"<!doctype html>", b"<?xml?>", b"a,b\n1,2\n", b"plain", b"", b"\xff\xfe\x00\x01" * 50)] == ["pdf", "jsonl", "json", "html", "xml", "csv", "text", None, None]


def test_policies(spark):
    rules = p.robots_rules(spark.createDataFrame([("e.example", "User-agent: *\nDisallow: /a\nAllow: /a/b$\n\nUser-agent: Loom\nUser-agent: Other\nDisallow: /*.pdf$\n")], "host string, text string"))
    urls = spark.createDataFrame([(f"https://e.example{x}",) for x in ("/a", "/a/b", "/a/b/c", "/", "/x.pdf")] + [("https://other.example/a",)], "url string")
    assert [x.allowed for x in p.robots_allowed(urls, rules).orderBy("url").collect()] == [True, False, True, False, True, True]
    assert {x.url for x in p.robots_allowed(urls, rules, "loom").where("NOT allowed").collect()} == {"https://e.example/x.pdf"}
    assert one(spark, p.content_usage, "train-ai=n, search=y; train-ai=y") == {"train-ai": "y", "search": "y"} and one(spark, lambda c: p.refusal(F.lit(200), c), "Please verify you are human") == "verify you are human"
    assert p.bounded_query("SELECT ?x WHERE {} LIMIT 900", 50).endswith("LIMIT 50") and p.bounded_query("SELECT ?x", 5).endswith("LIMIT 5")
    sites = spark.createDataFrame([("example.com", "", "plain"), ("shop.example.com", "/p", "shop")], "domain string, path_prefix string, site string")
    got = {x.url: x.site for x in p.known_sites(spark.createDataFrame([("https://shop.example.com/p/1",), ("https://a.example.com/",), ("https://other.org/",)], "url string"), sites).collect()}
    assert list(got.values()) == ["shop", "plain", None] or got["https://shop.example.com/p/1"] == "shop" and got["https://other.org/"] is None


def test_roles_and_profiles(spark):
    got = {a: (b, c_) for a, b, c_, _ in sc.propose_roles(["E-Mail", "Phone Numbr", "Owner Mailing Zip", "source_url", "Blob", "Name"])}
    assert got == {"E-Mail": ("email", "proposed"), "Phone Numbr": (None, "ambiguous"), "Owner Mailing Zip": (None, "ambiguous"), "source_url": ("ignore", "proposed"), "Blob": (None, "unmapped"), "Name": ("name", "proposed")}
    assert sc.confirm_mapping(["a", "b"], {"a": "phone"}, [1, 4]) == {"version": 5, "mapping": {"a": "phone", "b": "other"}}
    for bad in ({"z": "phone"}, {"a": "nonsense"}, {"a": "name", "b": "name"}):
        with pytest.raises(ValueError):
            sc.confirm_mapping(["a", "b"], bad)
    df = spark.createDataFrame([(1, "x", None), (2, "y", ""), (3, "x", None)], "n int, a string, b string")
    assert {(x.column_name, x.null_count, x.distinct_count, tuple(x.sample_values)) for x in sc.profile(df, ["a", "b"], "n", 1).collect()} == {("a", 0, 2, ("x",)), ("b", 3, 0, ())}
    assert sc.item_schema([{"name": "p", "type": "decimal", "required": True}]).simpleString() == "struct<p:double>"


def test_snapshots_and_streams(spark, tmp_path):
    a = spark.createDataFrame([("1", "x", "u", 1), ("1", "y", "u", 2), ("2", "z", "u", 1), (None, "q", "u", 1)], "k string, v string, source_url string, at int")
    b = spark.createDataFrame([("1", "y", "w", 1), ("3", "z", "u", 1), ("", "q", "u", 1)], "k string, v string, source_url string, at int")
    assert {(x.key, x.change) for x in sn.diff_records(a, b, ["k"], "at").collect()} == {('{"k":"1"}', "unchanged"), ('{"k":"2"}', "removed"), ('{"k":"3"}', "added")}
    assert {x.change: x.n for x in sn.diff_counts(a, b, ["k"], "at").collect()}["unkeyed"] == 1
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), (None, "e")], "source string, target string")
    assert {tuple(x) for x in sn.crawl(links, ["a"], most_depth=2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    states = sn.replay_jobs(spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "queued"), (2, 1, "running")], "job_id int, event_id int, state string"), {"draft": ["queued"], "queued": ["running"]})
    assert {tuple(x) for x in states.collect()} == {(1, "running", 2, 1), (2, "draft", 0, 1)}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    a.where("k IS NOT NULL").write.parquet(source)
    runs.watch(runs.read_events(spark, source, a.schema.simpleString()[7:-1].replace(":", " ")), out, str(tmp_path / "c"), ["k"], "at").awaitTermination()
    b.where("k <> ''").write.mode("append").parquet(source)
    runs.watch(runs.read_events(spark, source, a.schema.simpleString()[7:-1].replace(":", " ")), out, str(tmp_path / "c"), ["k"], "at").awaitTermination()
    assert {(x.key, x.change) for x in spark.read.parquet(f"{out}-diff/version=1").collect()} == {('{"k":"1"}', "unchanged"), ('{"k":"2"}', "removed"), ('{"k":"3"}', "added")}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    events.write.parquet(str(tmp_path / "e"))
    runs.write_once(runs.collected_once(runs.read_events(spark, str(tmp_path / "e"), "k int, t timestamp"), ["k"], "t"), str(tmp_path / "once"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2

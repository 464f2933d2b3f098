"""Readers of landed web material: N-Quads, capture indexes, archives, feeds, sitemaps, repositories and link lists.

Line formats are parsed by expressions and split over tasks; single documents are parsed by a function per row.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import transforms as tf
from rowloom.sources.files import parse_xml

MOST_LINE = 100_000


def nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """(subject, predicate, object, graph, is_literal) of N-Quads lines; lines that are longer than 100,000 letters or no quad are left out. Literals are decoded."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+("(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?|<[^>]*>|_:\S+)\s+(<[^>]*>)\s*\.\s*$'
    kept = lines.where(F.length(column) <= MOST_LINE).where(F.col(column).rlike(pattern))
    part = [F.regexp_extract(column, pattern, k) for k in range(1, 5)]
    return kept.select(tf.literal(part[0]).alias("subject"), tf.literal(part[1]).alias("predicate"), tf.literal(part[2]).alias("object"), tf.literal(part[3]).alias("graph"), part[2].startswith('"').alias("is_literal"))


def entities(quads: DataFrame) -> DataFrame:
    """(graph, subject, types, properties map<string,array<string>>) of the typed nodes of every page that no other node of it refers to; nested nodes are given under dotted names one level deep."""
    name = tf.local_name(F.col("predicate"))
    facts = quads.select("graph", "subject", name.alias("name"), "object", "is_literal", (F.col("predicate").endswith("#type")).alias("is_type"))
    types = facts.where("is_type").groupBy("graph", "subject").agg(F.array_sort(F.collect_set(tf.local_name(F.col("object")))).alias("types"))
    plain = facts.where("NOT is_type")
    inner = plain.where("NOT is_literal").join(plain.select("graph", F.col("subject").alias("object"), F.col("name").alias("inner"), F.col("object").alias("v"), F.col("is_literal").alias("leaf")), ["graph", "object"]).where("leaf")
    nested = inner.select("graph", "subject", F.concat_ws(".", "name", "inner").alias("name"), F.col("v").alias("object"))
    own = plain.where("is_literal").select("graph", "subject", "name", "object")
    referred = plain.where("NOT is_literal AND object <> subject").select("graph", F.col("object").alias("subject")).distinct()
    roots = types.join(referred, ["graph", "subject"], "left_anti")
    values = own.unionByName(nested).groupBy("graph", "subject", "name").agg(F.array_sort(F.collect_set("object")).alias("v"))
    grouped = values.groupBy("graph", "subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("properties"))
    return roots.join(grouped, ["graph", "subject"], "left")


def bulk_entities(spark: SparkSession, path: str, *, types: list[str] | None = None, domain: str | None = None) -> DataFrame:
    """Entities of N-Quads files, of some types and under a domain if they are named."""
    quads = nquads(spark.read.text(path))
    if domain:
        quads = quads.where(tf.host_under(F.lower(F.regexp_extract("graph", r"^[a-z]+://([^/?#:]+)", 1)), F.lit(domain)))
    found = entities(quads)
    return found.where(F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))) if types else found


def wayback_index(c: Column) -> Column:
    """array<map<string,string>> of a capture index given as a JSON table with a header row."""
    table = F.from_json(c, "array<array<string>>")
    return F.transform(F.slice(table, 2, F.greatest(F.size(table), F.lit(1))), lambda r: F.map_from_arrays(F.element_at(table, 1), r))


def crawl_index(lines: DataFrame, crawl: str, column: str = "value") -> DataFrame:
    """(url, timestamp, status, mime, digest, filename, offset, length, crawl) of a capture index given as JSON lines."""
    r = F.from_json(column, "url string, timestamp string, status string, mime string, digest string, filename string, offset string, length string")
    return lines.select(r.alias("r")).where("r.url IS NOT NULL").select("r.url", "r.timestamp", F.col("r.status").try_cast("int").alias("status"), "r.mime", "r.digest", "r.filename", F.col("r.offset").try_cast("long").alias("offset"), F.col("r.length").try_cast("long").alias("length"), F.lit(crawl).alias("crawl"))


def collections(c: Column) -> Column:
    """array<struct<id,name,cdx-api>> of a list of crawls."""
    return F.from_json(c, "array<struct<id:string,name:string,`cdx-api`:string>>")


def link_list(texts: DataFrame, base: str, url: str = "url", column: str = "text") -> DataFrame:
    """(url, position, section, title, link, note, optional) of the links of Markdown link lists, in order, under their headings."""
    lines = texts.select(url, F.posexplode(F.split(column, r"\r?\n")).alias("position", "line"))
    head = F.nullif(F.regexp_extract("line", r"^#+\s+(.*\S)\s*$", 1), F.lit(""))
    at = lines.groupBy(url).agg(F.array_sort(F.collect_list(F.when(head.isNotNull(), F.struct("position", head.alias("h"))))).alias("heads"))
    pattern = r"^\s*[-*]\s*\[([^\]]+)\]\(([^)\s]+)\)\s*:?\s*(.*)$"
    links = lines.where(F.col("line").rlike(pattern)).join(at, url)
    section = F.element_at(F.filter("heads", lambda h: h["position"] < F.col("position")), -1)["h"]
    section = F.when(F.size(F.filter("heads", lambda h: h["position"] < F.col("position"))) > 0, section)
    return links.select(url, "position", section.alias("section"), F.regexp_extract("line", pattern, 1).alias("title"), tf.absolute_url(F.regexp_extract("line", pattern, 2), base).alias("link"), F.regexp_extract("line", pattern, 3).alias("note"), (F.lower(F.coalesce(section, F.lit(""))) == "optional").alias("optional"))


def markdown_record(c: Column) -> Column:
    """struct(title, text) of a Markdown page: its first heading and all of it."""
    return F.struct(F.nullif(F.trim(F.regexp_extract(c, r"(?m)^#+ *(.*)$", 1)), F.lit("")).alias("title"), c.alias("text"))


# --- documents by a function -------------------------------------------------------------------------------------------


def sniff(content: bytes) -> str | None:
    """Type of a document by its first bytes and letters; null for unknown binary content."""
    head = content[:4096]
    for magic, kind in ((b"%PDF-", "pdf"), (b"PAR1", "parquet"), (b"\x1f\x8b", "gz")):
        if head.startswith(magic):
            return kind
    if head.startswith(b"PK\x03\x04"):
        return "xlsx" if b"xl/" in content else "docx" if b"word/" in content else "zip"
    try:
        text = head.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            return None
        text = head[: e.start].decode("utf-8-sig", "ignore")
    s = text.lstrip()
    if not s:
        return None
    if s[0] in "[{":
        lines = [x for x in text.splitlines() if x.strip()]
        return "jsonl" if s[0] == "{" and len(lines) > 1 and all(x.lstrip().startswith("{") and x.rstrip().endswith("}") for x in lines[:2]) else "json"
    low = s[:512].lower()
    if low.startswith("<!doctype html") or "<html" in low:
        return "html"
    if low.startswith(("<?xml", "<rss", "<feed", "<urlset", "<sitemapindex")):
        return "xml"
    lines = s.splitlines()[:5]
    if len(lines) > 1 and lines[0].count(",") and len({x.count(",") for x in lines[:-1]}) == 1:
        return "csv"
    return "text"


def _tag(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _child(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for x in node:
            if _tag(x) == name and (text := " ".join("".join(x.itertext()).split())):
                return text
    return None


def feed_entries(content: bytes, base: str) -> list[dict]:
    """Entries of an RSS, Atom or JSON feed: title, link, id, published, author, summary, categories."""
    if content.lstrip()[:1] == b"{":
        return [
            {"title": e.get("title"), "link": urljoin(base, e.get("url") or ""), "id": str(e.get("id") or e.get("url") or ""), "published": e.get("date_published"), "author": (e.get("author") or {}).get("name"), "summary": e.get("summary") or e.get("content_text"), "categories": ", ".join(e.get("tags") or [])}
            for e in json.loads(content).get("items", [])
        ]
    out = []
    for e in parse_xml(content).iter():
        if _tag(e) not in ("item", "entry"):
            continue
        links = [x for x in e if _tag(x) == "link"]
        link = next((x.get("href") for x in links if x.get("href") and x.get("rel", "alternate") == "alternate"), None) or _child(e, "link")
        categories = [x.get("term") or (x.text or "") for x in e if _tag(x) == "category"]
        author = next((_child(x, "name") or x.text for x in e if _tag(x) in ("author", "creator")), None)
        out.append({"title": _child(e, "title"), "link": urljoin(base, link) if link else None, "id": _child(e, "guid", "id") or link, "published": _child(e, "pubDate", "published", "updated", "date"), "author": author, "summary": _child(e, "description", "summary"), "categories": ", ".join(c for c in categories if c)})
    return out


def sitemap_entries(content: bytes, most: int = 50_000) -> list[dict]:
    """(kind, loc, lastmod) of a sitemap: pages of a URL set or a text list, maps of an index; packed ones are unpacked. A sitemap has at most 50,000 entries by its standard."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if not content.lstrip().startswith(b"<"):
        return [{"kind": "page", "loc": x.strip(), "lastmod": None} for x in content.decode("utf-8", "replace").splitlines() if x.strip().startswith("http")][:most]
    root = parse_xml(content)
    kind = "map" if _tag(root) == "sitemapindex" else "page"
    return [{"kind": kind, "loc": loc, "lastmod": _child(x, "lastmod")} for x in root if (loc := _child(x, "loc"))][:most]


def repository_records(content: bytes) -> list[dict]:
    """(identifier, datestamp, status, fields, token) of a ListRecords answer: leaves with several values joined; token goes on to the next page."""
    root = parse_xml(content)
    token = next((x.text for x in root.iter() if _tag(x) == "resumptionToken" and x.text), None)
    out = []
    for r in (x for x in root.iter() if _tag(x) == "record"):
        head = next((x for x in r if _tag(x) == "header"), None)
        fields: dict[str, list[str]] = {}
        for m in (x for x in r if _tag(x) == "metadata"):
            for leaf in m.iter():
                if not len(leaf) and (leaf.text or "").strip():
                    fields.setdefault(_tag(leaf), []).append(leaf.text.strip())
        out.append({"identifier": _child(head, "identifier") if head is not None else None, "datestamp": _child(head, "datestamp") if head is not None else None, "status": head.get("status") if head is not None else None, "fields": {k: "; ".join(v) for k, v in fields.items()}, "token": token})
    return out


def warc_records(content: bytes) -> Iterator[tuple[str, str, int | None, bytes]]:
    """(type, url, status, payload) of the records of a web archive file, packed or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BufferedReader(io.BytesIO(content))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (h := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = h.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        body = stream.read(int(head.get("content-length", 0)))
        status = None
        if head.get("warc-type") == "response" and body.startswith(b"HTTP/"):
            top, _, rest = body.partition(b"\r\n\r\n")
            found = re.match(rb"HTTP/\S+\s+(\d{3})", top)
            status, body = int(found[1]) if found else None, rest
        yield head.get("warc-type", ""), head.get("warc-target-uri", ""), status, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, url, status, body) of the responses of web archive files; one task reads one file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                for kind, url, status, body in warc_records(content):
                    if kind == "response":
                        yield pd.DataFrame({"file": [p], "url": [url], "status": pd.array([status], dtype="Int32"), "body": [body]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, url string, status int, body binary")


def each(df: DataFrame, url: str, content: str, parse, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows that a parser of one document gives for every document, with its url; a document that cannot be parsed gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", schema)]
        for batch in batches:
            rows = []
            for u, c in zip(batch[url], batch[content], strict=True):
                if c is None:
                    continue
                raw = c.encode() if isinstance(c, str) else bytes(c)
                try:
                    found = list(parse(raw, u))
                except (ValueError, ET.ParseError, KeyError, OSError):
                    found = []
                rows += [(u, *(r.get(n) for n in names)) for r in found]
            yield pd.DataFrame(rows, columns=[url, *names])

    return df.select(url, content).mapInPandas(run, f"{url} string, {schema}")

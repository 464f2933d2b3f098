"""Records out of landed HTML and JSON pages: a small document tree of the standard parser, selectors, structured data, articles, links.

The tree and the selectors are plain functions over one page; the operators run them in Arrow batches, a page a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.sources.files import flat_xml, parse_xml, unique_headers

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "section", "article"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    """An element with its children in order; texts are strings among them."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: Mapping[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, dict(attrs), parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, skip: frozenset[str] = frozenset({"script", "style", "template"})) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip or x is self:
                todo += reversed(x.children)
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.at.parent is not None and tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:(first-child|last-child|nth-child\(\d+\)|nth-of-type\(\d+\))")


@lru_cache(maxsize=4096)
def _compiled(selector: str) -> tuple[tuple[tuple[str, tuple[tuple, ...]], ...], ...]:
    """Alternatives of a selector, each its steps from left to right: (combinator, tests)."""
    out = []
    for part in re.split(r",(?![^\[]*\])", selector):
        steps, combinator = [], " "
        for token in re.findall(r"\s*[>+~]\s*|\s+|(?:\[[^\]]*\]|[^\s>+~\[])+", part.strip()):
            if not token.strip() or token.strip() in ">+~":
                combinator = token.strip() or " "
                continue
            at, tests = 0, []
            while at < len(token):
                m = _SIMPLE.match(token, at)
                if not m:
                    raise ValueError(f"selector not understood: {selector}")
                tests.append(m.groups())
                at = m.end()
            steps.append((combinator, tuple(tests)))
            combinator = " "
        out.append(tuple(steps))
    return tuple(out)


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if isinstance(c, Node)] if n.parent else [n]


def _passes(n: Node, tests: tuple[tuple, ...]) -> bool:
    for tag, ident, cls, attr, op, value, pseudo in tests:
        if tag and tag != "*" and n.tag != tag.lower() or ident and n.attrs.get("id") != ident or cls and cls not in n.attrs.get("class", "").split():
            return False
        if attr:
            have = n.attrs.get(attr.lower())
            want = value.strip("\"'") if value else ""
            fits = {None: True, "=": have == want, "~=": want in (have or "").split(), "^=": (have or "").startswith(want), "$=": (have or "").endswith(want), "*=": want in (have or ""), "|=": have == want or (have or "").startswith(want + "-")}
            if have is None or not fits[op]:
                return False
        if pseudo:
            row = _siblings(n)
            if pseudo.startswith("nth-of-type"):
                row = [x for x in row if x.tag == n.tag]
            k = row.index(n) + 1
            wanted = 1 if pseudo == "first-child" else len(row) if pseudo == "last-child" else int(pseudo[pseudo.index("(") + 1 : -1])
            if k != wanted:
                return False
    return True


def _fits(n: Node, steps: tuple, top: Node) -> bool:
    if not _passes(n, steps[-1][1]):
        return False
    if len(steps) == 1:
        return steps[0][0] != ">" or n.parent is top
    combinator, rest = steps[-1][0], steps[:-1]
    if combinator in "+~":
        before = _siblings(n)[: _siblings(n).index(n)]
        return any(_fits(x, rest, top) for x in (before[-1:] if combinator == "+" else before))
    p = n.parent
    while p is not None and p is not top.parent:
        if _fits(p, rest, top):
            return True
        if combinator == ">":
            return False
        p = p.parent
    return False


def select(top: Node, selector: str) -> list[Node]:
    """Elements below a node that fit a selector: tags, #id, .class, [attr] with its operators, child, descendant, sibling, first, last and nth."""
    alternatives = _compiled(selector)
    return [n for n in top.walk() if any(_fits(n, steps, top) for steps in alternatives)]


def value_of(top: Node, selectors: Sequence[str]) -> str | None:
    """Value of the first selector that finds any: ``::text`` (also without a mark) or ``::attr(name)``; the node itself without a path."""
    for s in selectors:
        path, _, what = s.partition("::")
        found = select(top, path.strip()) if path.strip() else [top]
        for n in found:
            v = n.attrs.get(what[5:-1]) if what.startswith("attr(") else n.text()
            if v:
                return v
    return None


def selector_records(html: str, url: str, root: str, fields: Sequence[Mapping]) -> list[dict[str, str | None]]:
    """One record per element of ``root`` with the fields' selectors; addresses are made absolute."""
    out = []
    for n in select(parse(html), root):
        r = {f["name"]: value_of(n, f["selectors"]) for f in fields}
        for f in fields:
            if f.get("type") == "url" and r[f["name"]]:
                r[f["name"]] = urljoin(url, r[f["name"]])
        out.append(r)
    return out


def links(html: str, url: str) -> list[str]:
    """Absolute http links of a page in order, each once, fragments dropped, those marked nofollow left out; a base element counts."""
    tree = parse(html)
    base = next((urljoin(url, n.attrs["href"]) for n in tree.walk() if n.tag == "base" and n.attrs.get("href")), url)
    out: dict[str, None] = {}
    for n in tree.walk():
        if n.tag == "a" and n.attrs.get("href") and "nofollow" not in n.attrs.get("rel", "").lower().split():
            link = urldefrag(urljoin(base, n.attrs["href"].strip()))[0]
            if link.startswith(("http://", "https://")):
                out.setdefault(link)
    return list(out)


# --- structured data ----------------------------------------------------------------------------------------------------


def _nodes(x: object, out: list[dict]) -> None:
    """Typed objects of a JSON-LD value: of graphs, lists and containers."""
    if isinstance(x, list):
        for y in x:
            _nodes(y, out)
    elif isinstance(x, dict):
        if "@graph" in x:
            _nodes(x["@graph"], out)
        if x.get("@type"):
            out.append(x)
        for key in ("mainEntity", "itemListElement", "item", "hasVariant"):
            if key in x:
                _nodes(x[key], out)


def _microdata(tree: Node) -> list[dict]:
    out = []

    def value(n: Node) -> object:
        if "itemscope" in n.attrs:
            return item(n)
        for a in ("content", "href", "src", "datetime"):
            if n.attrs.get(a):
                return n.attrs[a]
        return n.text()

    def item(n: Node) -> dict:
        got: dict[str, object] = {"@type": n.attrs.get("itemtype", "").rsplit("/", 1)[-1]}
        todo = [c for c in n.children if isinstance(c, Node)]
        while todo:
            c = todo.pop(0)
            if c.attrs.get("itemprop"):
                got.setdefault(c.attrs["itemprop"], value(c))
            if "itemscope" not in c.attrs:
                todo = [x for x in c.children if isinstance(x, Node)] + todo
        return got

    for n in tree.walk():
        if "itemscope" in n.attrs and not n.attrs.get("itemprop"):
            out.append(item(n))
    return out


def structured(html: str) -> list[dict]:
    """(syntax, type, data) of the entities that a page gives as JSON-LD or microdata."""
    tree, out = parse(html), []
    for n in tree.walk():
        if n.tag == "script" and n.attrs.get("type", "").lower().startswith("application/ld+json"):
            try:
                found: list[dict] = []
                _nodes(json.loads("".join(c for c in n.children if isinstance(c, str))), found)
            except ValueError:
                continue
            for x in found:
                kinds = x["@type"] if isinstance(x["@type"], list) else [x["@type"]]
                out += [{"syntax": "json-ld", "type": str(k).rsplit("/", 1)[-1], "data": x} for k in kinds[:1]]
    return out + [{"syntax": "microdata", "type": x["@type"], "data": x} for x in _microdata(tree)]


def scalar(x: object) -> str | None:
    """A value as text: of an object its value or name, of a list its parts."""
    if isinstance(x, dict):
        return next((scalar(x[k]) for k in ("@value", "value", "name", "url", "@id") if k in x), None)
    if isinstance(x, list):
        return ", ".join(v for v in map(scalar, x) if v) or None
    if isinstance(x, bool):
        return "true" if x else "false"
    return None if x is None else str(x)


def json_path(x: object, path: str) -> object:
    """A value by a dotted path: keys, places in lists, * for the first value there is."""
    for step in path.split(".") if path else []:
        if isinstance(x, list):
            if step == "*":
                x = x[0] if x else None
            elif step.lstrip("-").isdigit() and -len(x) <= int(step) < len(x):
                x = x[int(step)]
            else:
                return None
        elif isinstance(x, dict):
            x = next(iter(x.values()), None) if step == "*" else x.get(step)
        else:
            return None
    return x


def json_records(text: str, item_path: str, fields: Mapping[str, str]) -> list[dict[str, str | None]]:
    """Records of a JSON document: the objects at a path, or arrays of one length beside each other zipped; fields are paths in each."""
    found = json_path(json.loads(text), item_path)
    if isinstance(found, dict) and found and all(isinstance(v, list) for v in found.values()):
        found = [dict(zip(found, row, strict=False)) for row in zip(*found.values(), strict=False)]
    rows = found if isinstance(found, list) else [found] if isinstance(found, dict) else []
    return [{name: scalar(json_path(r, path)) for name, path in fields.items()} for r in rows if isinstance(r, dict)]


def xml_records(content: bytes, tag: str) -> list[dict[str, str]]:
    """Flat records of the elements of a tag, whatever their namespace."""
    return [flat_xml(x) for x in parse_xml(content).iter() if x.tag.rsplit("}", 1)[-1] == tag]


def article(html: str, url: str, least: int = 200) -> dict | None:
    """(title, author, published, text, words) of the main text of a page; null if it has under ``least`` letters.

    The main text is the article or main element, else the element whose own paragraphs hold most text and fewest links.
    """
    tree = parse(html)
    meta = {n.attrs.get("property") or n.attrs.get("name") or "": n.attrs.get("content", "") for n in tree.walk() if n.tag == "meta"}
    skip = frozenset({"script", "style", "template", "nav", "footer", "aside", "header", "form"})
    main = next((n for tag in ("article", "main") for n in tree.walk() if n.tag == tag), None)
    if main is None:
        def weight(n: Node) -> int:
            own = sum(len(c.text(skip)) for c in n.children if isinstance(c, Node) and c.tag == "p")
            return own - 2 * sum(len(a.text()) for c in n.children if isinstance(c, Node) and c.tag == "p" for a in c.walk() if a.tag == "a")

        main = max((n for n in tree.walk() if n.tag not in skip), key=weight, default=None)
    text = main.text(skip) if main is not None else ""
    if len(text) < least:
        return None
    first = lambda tag: next((n.text() for n in tree.walk() if n.tag == tag and n.text()), None)
    when = meta.get("article:published_time") or meta.get("date") or next((n.attrs.get("datetime") for n in tree.walk() if n.tag == "time" and n.attrs.get("datetime")), None)
    return {"title": meta.get("og:title") or first("h1") or first("title"), "author": meta.get("author") or meta.get("article:author"), "published": when, "text": text, "words": len(text.split())}


def table_records(html: str) -> list[dict[str, str]]:
    """Rows of the tables of a page by their header cells, with the number of the table."""
    out = []
    for k, table in enumerate((n for n in parse(html).walk() if n.tag == "table"), 1):
        rows = [[c.text() for c in r.walk() if c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
        rows = [r for r in rows if any(r)]
        if len(rows) > 1:
            head = unique_headers(rows[0])
            out += [{**dict(zip(head, r, strict=False)), "source_table": str(k)} for r in rows[1:]]
    return out


def sanitize(html: str) -> tuple[str, dict[str, int]]:
    """A page without scripts, event handlers, forms' values and secrets in links, and how many of each were taken out."""
    n: dict[str, int] = {}

    def cut(pattern: str, to: str, what: str, text: str) -> str:
        out, k = re.subn(pattern, to, text, flags=re.IGNORECASE | re.DOTALL)
        n[what] = n.get(what, 0) + k
        return out

    html = cut(r"<script\b(?![^>]*ld\+json)[^>]*>.*?</script\s*>", "", "scripts", html)
    html = cut(r"<(?:iframe|object|embed)\b.*?(?:</(?:iframe|object|embed)\s*>|/>)", "", "frames", html)
    html = cut(r"\son\w+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", "handlers", html)
    html = cut(r"(<input\b[^>]*?)\svalue\s*=\s*(?:\"[^\"]*\"|'[^']*')", r"\1", "values", html)
    html = cut(r"([?&][^=&\"']*(?:token|secret|key|session|auth)[^=&\"']*=)[^&\"'#\s]+", r"\1REDACTED", "tokens", html)
    return html, n


def to_markdown(html: str, url: str) -> str:
    """Headings, paragraphs, lists and links of a page as Markdown."""
    tree, out = parse(html), []
    inner = frozenset({"script", "style", "template", "nav", "footer"})
    for n in tree.walk():
        if n.tag in ("h1", "h2", "h3", "h4"):
            out.append("#" * int(n.tag[1]) + " " + n.text(inner))
        elif n.tag == "li":
            out.append("- " + n.text(inner))
        elif n.tag == "p":
            out.append(n.text(inner))
        elif n.tag == "a" and n.parent is not None and n.parent.tag not in ("p", "li", "h1", "h2", "h3", "h4") and n.attrs.get("href"):
            out.append(f"[{n.text(inner)}]({urljoin(url, n.attrs['href'])})")
    return "\n\n".join(x for x in out if x.strip("#- "))


def css_path(node: Node) -> str:
    """A selector that finds a node again: by its id, else by tag, classes and place up to the next id."""
    steps = []
    n: Node | None = node
    while n is not None and n.tag != "#root":
        if n.attrs.get("id"):
            steps.append(f"#{n.attrs['id']}")
            break
        same = [x for x in _siblings(n) if x.tag == n.tag]
        steps.append(n.tag + "".join(f".{c}" for c in n.attrs.get("class", "").split()[:2]) + (f":nth-of-type({same.index(n) + 1})" if len(same) > 1 else ""))
        n = n.parent
    return " > ".join(reversed(steps))


def repeated_root(html: str) -> str | None:
    """Selector of the largest group of sibling elements of one tag and class that hold a link each; null without three of them."""
    groups: dict[tuple, int] = {}
    for n in parse(html).walk():
        if n.attrs.get("class") and any(x.tag == "a" for x in n.walk()):
            key = (id(n.parent), n.tag, n.attrs["class"].split()[0])
            groups[key] = groups.get(key, 0) + 1
    best = max(groups.items(), key=lambda x: x[1], default=None)
    return f"{best[0][1]}.{best[0][2]}" if best and best[1] >= 3 else None


def element_print(n: Node) -> dict:
    """What tells an element again: tag, id, classes, attribute names, tags of its ancestors, shape and length of its text."""
    path, p = [], n.parent
    while p is not None:
        path.append(p.tag)
        p = p.parent
    text = n.text()
    return {"tag": n.tag, "id": n.attrs.get("id", ""), "classes": sorted(n.attrs.get("class", "").split()), "attributes": sorted(n.attrs), "path": path, "shape": re.sub(r"[a-zA-Z]+", "a", re.sub(r"\d+", "0", text))[:40], "length": len(text)}


def print_similarity(a: Column, b: Column) -> Column:
    """Weighted likeness of two element prints as structs, 0 to 1."""
    overlap = lambda x, y: F.when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    same = lambda f: (a[f] == b[f]).cast("double")
    near = 1.0 - F.least(F.lit(1.0), F.abs(a["length"] - b["length"]) / F.greatest(a["length"], b["length"], F.lit(1)))
    total = 2 * same("tag") + 2 * overlap(a["classes"], b["classes"]) + overlap(a["attributes"], b["attributes"]) + 2 * overlap(a["path"], b["path"]) + same("id") + 2 * same("shape") + near
    return total / 11


# --- over tables of pages --------------------------------------------------------------------------------------------------


def pages_to_rows(pages: DataFrame, key: str, url: str, body: str, run: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """Rows that a function of one page gives for every page, under the page's key; a page that cannot be read gives none."""
    names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", schema)]
    kind = dict(pages.dtypes)[key]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, u, b in zip(batch[key], batch[url], batch[body], strict=True):
                if b is None:
                    continue
                try:
                    found = run(b, u or "")
                except ValueError:
                    found = []
                rows += [(k, *(r.get(n) for n in names)) for r in found]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pages.select(key, url, body).mapInPandas(each, f"{key} {kind}, {schema}")


def merge_syntaxes(found: DataFrame, page: str) -> DataFrame:
    """(page, type, key, field, values, conflict) of structured entities of one page by type and key, whatever their syntax: equal values merged, different ones all kept.

    found: (page, syntax, type, key, field, value).
    """
    return found.where("value IS NOT NULL").groupBy(page, "type", "key", "field").agg(F.array_sort(F.collect_set("value")).alias("values")).withColumn("conflict", F.size("values") > 1)


def decoded(c: Column) -> Column:
    """A text with the HTML entities that have names of their own decoded."""
    out = c
    for name in ("lt", "gt", "quot", "apos", "nbsp", "copy", "euro", "ndash", "mdash", "hellip", "amp"):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(unescape(f"&{name};")))
    return out

"""Transforms of collected values by name, and small parsers of web and public-record texts; all inside the JVM."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import text as t

# Signs of currencies, suffixes under which names are registered, formats of dates.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₺": "TRY", "₴": "UAH", "₦": "NGN", "USD": "USD", "EUR": "EUR", "GBP": "GBP", "CHF": "CHF", "JPY": "JPY", "CAD": "CAD", "AUD": "AUD", "EGP": "EGP"}
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.tr", "com.cn", "com.hk", "com.sg", "co.in", "co.za", "co.kr", "com.eg", "com.ar", "github.io")
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy HH:mm:ss Z")


def strip_html(c: Column) -> Column:
    """Text without tags and comments, the common entities decoded."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return collapse(bare)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def number(c: Column) -> Column:
    """First number of a text as text, commas of thousands dropped; null if there is none."""
    return t.parse_decimal(c)


def integer(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?[0-9]+)", 1).try_cast("bigint")


def absolute_url(c: Column, base: str | Column) -> Column:
    """A link against the address of its page: absolute, scheme-relative, rooted, query, fragment or relative with dots."""
    b = F.lit(base) if isinstance(base, str) else base
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.when(page.rlike(r"^[^:]*://[^/]*/"), F.regexp_replace(page, r"[^/]*$", "")).otherwise(F.concat(page, F.lit("/")))
    link = F.trim(c)
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(b, r"^([^:]*:)", 1), link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link)).when(link.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), link)).when(link == "", b).otherwise(F.concat(folder, link))
    )
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/[^/]+/\.\./", "/"), r"(://[^/]*)/\.\./", "$1/")


def drop_params(c: Column, params: Sequence[str]) -> Column:
    """A URL with the host in lower case, without the named parameters and the fragment; the others keep their order."""
    bare = F.regexp_replace(c, "#.*$", "")
    head = F.regexp_extract(bare, r"^([^:]*://[^/?]*)", 1)
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*params))
    return F.concat(F.lower(head), F.regexp_extract(bare, r"^[^:]*://[^/?]*([^?]*)", 1), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def with_param(c: Column, name: str, value: Column) -> Column:
    """A URL with a query parameter set, earlier ones of its name replaced."""
    kept = F.filter(F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    return F.concat(F.regexp_replace(c, r"[?#].*$", ""), F.lit("?"), F.array_join(F.array_append(kept, F.concat(F.lit(f"{name}="), value.cast("string"))), "&"))


def price(c: Column) -> Column:
    """struct(amount, currency): the first number, with a comma for decimals where two figures follow it, and the currency by its sign or code."""
    raw = F.regexp_extract(c, r"([0-9][0-9.,  ]*)", 1)
    tight = F.regexp_replace(raw, r"[  ]", "")
    amount = F.when(tight.rlike(r",[0-9]{2}$") & ~tight.rlike(r"\.[0-9]{2}$"), F.replace(F.replace(tight, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.regexp_replace(F.replace(tight, F.lit(","), F.lit("")), r"\.$", ""))
    sign = F.coalesce(*[F.when(c.contains(k), v) for k, v in CURRENCIES.items()])
    return F.struct(F.nullif(amount, F.lit("")).alias("amount"), sign.alias("currency"))


def date_text(c: Column) -> Column:
    """ISO date, or date and time, of a text in one of the usual formats; null for others."""
    v = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<=[0-9])(st|nd|rd|th)\b", ""), r"^\s*[A-Za-z]{3,9},\s*", ""))
    at = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in DATE_FORMATS])
    return F.when(v.rlike(r"[0-9]:[0-9]{2}"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def us_date(c: Column) -> Column:
    """ISO date of 12/31/2024 or December 31, 2024; empty for others."""
    v = F.trim(c)
    return F.coalesce(F.date_format(F.coalesce(F.try_to_timestamp(v, F.lit("M/d/yyyy")), F.try_to_timestamp(v, F.lit("MMMM d, yyyy"))), "yyyy-MM-dd"), F.lit(""))


def money(c: Column) -> Column:
    """Digits and point of an amount."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.]", "")


def roll_date(c: Column) -> Column:
    """ISO date of a roll; its zero dates are empty."""
    return F.when(F.trim(c).isin("12/30/1899", "12/31/1899", ""), "").otherwise(us_date(c))


def roll_number(c: Column) -> Column:
    """A number of a roll without decimals of zero; zeros are empty."""
    v = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.0*$", "")
    return F.when(v.rlike(r"^0*$"), "").otherwise(v)


def registrable_domain(c: Column) -> Column:
    """The registered name of a host or URL: its last two labels, three under the usual two-part suffixes; null without one."""
    host = F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^([^/?#]*)", 1), r"^.*@|:\d+$", ""))
    labels = F.split(host, r"\.")
    keep = F.when(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".").isin(*TWO_PART_SUFFIXES), 3).otherwise(2)
    named = (F.size(labels) >= keep) & ~host.rlike(r"^[0-9.]+$") & (F.element_at(labels, -1) != "")
    return F.when(named, F.array_join(F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), keep), "."))


def host_under(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or lies under it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def clean_url(c: Column) -> Column:
    """A URL whose parameters that carry secrets are blanked."""
    return F.regexp_replace(c, r"(?i)([?&](?:[^=&]*(?:token|secret|key|password|session|auth|signature)[^=&]*)=)[^&#]*", "$1REDACTED")


def log_redaction(c: Column) -> Column:
    """A log line without bearer tokens, secrets in key=value form, mail addresses and credentials in URLs."""
    out = F.regexp_replace(c, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", "$1 [redacted]")
    out = F.regexp_replace(out, r"(?i)\b((?:api[_-]?key|token|secret|password|authorization|cookie)\s*[=:]\s*)[^\s,;&]+", "$1[redacted]")
    return F.regexp_replace(F.regexp_replace(out, r"://[^/@\s]+@", "://[redacted]@"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")


def western_digits(c: Column) -> Column:
    """Arabic, Persian and full-width digits as 0 to 9."""
    rows = ["".join(chr(first + k) for k in range(10)) for first in (0x660, 0x6F0, 0xFF10, 0x966)]
    return F.translate(c, "".join(rows), "0123456789" * len(rows))


def multiplied(c: Column) -> Column:
    """A number with k, m or b behind it as a double."""
    v = F.lower(F.replace(western_digits(c), F.lit(","), F.lit("")))
    figure, sign = F.regexp_extract(v, r"(-?[0-9]+(?:\.[0-9]+)?)\s*([kmb])?\b", 1), F.regexp_extract(v, r"(-?[0-9]+(?:\.[0-9]+)?)\s*([kmb])?\b", 2)
    return figure.try_cast("double") * F.when(sign == "k", 1e3).when(sign == "m", 1e6).when(sign == "b", 1e9).otherwise(1.0)


def page_number(c: Column) -> Column:
    """Page number of a URL: of a page parameter, or of a page in its path; null without one."""
    found = F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)[?&](?:page|p|pg|paged|pageno|page_number)=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"(?i)/(?:page|p)[/-]?(\d+)(?:[/?#]|$)", 1), F.lit("")))
    return found.cast("int")


def retry_after(c: Column, now: Column) -> Column:
    """Seconds to wait: a number, or until an HTTP date; never negative; null for others."""
    v = F.trim(c)
    at = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.coalesce(v.try_cast("double"), (F.unix_micros(at) - F.unix_micros(now)) / 1e6), F.lit(0.0))


def pages_wanted(c: Column) -> Column:
    """Page numbers of "1-3,7" in order; what is no page is left out."""
    parts = F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    span = lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.greatest(F.substring_index(p, "-", -1).cast("int"), F.substring_index(p, "-", 1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def cell_value(c: Column, column: str) -> Column:
    """struct(kind, value) of a spreadsheet cell: identifiers stay text, yes and no, numbers, dates, text of at most 32,000 letters with formulas as text."""
    v = F.coalesce(F.trim(c), F.lit(""))
    text_column = any(x in column.lower() for x in ("id", "zip", "phone", "account", "sku", "asin"))
    kind = F.when(v == "", "empty").when(F.lit(text_column), "text").when(F.lower(v).isin("true", "false"), "flag").when(v.rlike(r"^-?\d{1,15}(\.\d+)?$"), "number").when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").otherwise("text")
    safe = F.when(v.rlike(r"^[=+@]") | (v.startswith("-") & ~v.rlike(r"^-\d")), F.concat(F.lit("'"), v)).otherwise(v)
    return F.struct(kind.alias("kind"), F.when(kind == "flag", F.when(F.lower(v) == "true", "Yes").otherwise("No")).when(kind == "text", F.substring(safe, 1, 32000)).otherwise(v).alias("value"))


def site_name(host: Column) -> Column:
    """A host as a title: without www and its last label, words capitalised."""
    return F.initcap(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.[a-z]+$", ""), r"[.-]", " "))


def literal(c: Column) -> Column:
    """Text of an N-Quads term: quotes and escapes of a literal undone, an IRI without its angle brackets."""
    body = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(body, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(c.startswith('"'), plain).when(c.startswith("<"), F.regexp_replace(c, r"^<|>$", "")).otherwise(c)


def local_name(c: Column) -> Column:
    """Last part of an IRI."""
    return F.regexp_extract(F.regexp_replace(c, r"[<>]", ""), r"([^/#]*)$", 1)


#: name -> transform of a collected value
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim, "collapse_whitespace": collapse, "lowercase": F.lower, "strip_html": strip_html, "parse_currency_amount": number, "parse_rating": number, "parse_integer": lambda c: integer(c).cast("string"),
    "normalize_phone": t.phone, "parse_price": lambda c: price(c)["amount"], "price_currency": lambda c: price(c)["currency"], "parse_date": date_text, "registrable_domain": registrable_domain, "western_digits": western_digits,
}
_CASTS: dict[str, Callable[[Column], Column]] = {"string": lambda c: c.cast("string"), "url": lambda c: c.cast("string"), "decimal": lambda c: number(c).try_cast("double"), "integer": integer}


def register(name: str, build: Callable[[Column], Column]) -> None:
    """Adds a transform under a name of its own."""
    if name in TRANSFORMS:
        raise ValueError(f"there is a transform {name}")
    TRANSFORMS[name] = build


def apply_field(value: Column, field: Mapping, base: str | Column = "", drop: Sequence[str] = ()) -> Column:
    """A value through the transforms of a field in order and then to its type; empty becomes null."""
    bound = {**TRANSFORMS, "to_absolute_url": lambda c: absolute_url(c, base), "canonicalize_url": lambda c: drop_params(c, drop)}
    out = functools.reduce(lambda v, name: bound[name](v), field.get("transforms", ()), value)
    return F.nullif(_CASTS[field.get("type", "string")](out).cast("string"), F.lit("")).cast({"decimal": "double", "integer": "bigint"}.get(field.get("type", "string"), "string"))

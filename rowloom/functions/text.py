"""Column builders for standardizing typed values; all stay inside the JVM and take and give Columns.

Null gives null unless a builder says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.fixed import DOTLESS_DOMAINS, LEGAL_FORMS, PLACEHOLDERS, PLUS_TAG_DOMAINS, TRACKING

#: letters of the Latin, Greek-free blocks; folding tables are made from their decompositions
_LATIN = [chr(o) for o in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))]


def _mapping(form: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """Letters that become one letter, what they become, and letters that become several."""
    one, many = {}, {}
    for c in _LATIN:
        to = form(c)
        if to != c:
            (one if len(to) == 1 else many)[c] = to
    return "".join(one), "".join(one.values()), {c: t for c, t in many.items() if t.isalpha()}


_ASCII = _mapping(lambda c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())
_COMPATIBLE = _mapping(lambda c: unicodedata.normalize("NFKC", c))


def literal_map(entries: Mapping[str, str]) -> Column:
    """A fixed table as one map literal, made by a single expression."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in entries.items()) + ")")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(c: Column, table: tuple[str, str, dict[str, str]]) -> Column:
    out = F.translate(c, table[0], table[1])
    for many, to in table[2].items():
        out = F.replace(out, F.lit(many), F.lit(to))
    return out


def ascii_fold(c: Column) -> Column:
    """A text without accents; what has no ASCII letters is dropped."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.regexp_replace(_folded(c, _ASCII), r"[^\x00-\x7F]", ""))


def compatible(c: Column) -> Column:
    """Full-width and other compatibility letters as plain ones; Latin letters followed by one of the usual combining marks as one letter."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(bind(_folded(c, _COMPATIBLE), lambda o: F.when(o.rlike(r"\p{Mn}"), composed(o)).otherwise(o)))


#: letters with one combining mark, and the letter they make, for all marks of the Latin blocks
_COMPOSITIONS = {d: c for c in _LATIN if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii()}


def composed(c: Column) -> Column:
    """Latin letters and a combining mark as one letter (canonical composition)."""
    table = literal_map(_COMPOSITIONS)
    pieces = F.split(c, r"(?=[A-Za-z][\x{0300}-\x{0331}])|(?<=[\x{0300}-\x{0331}])")
    return F.when(c.rlike(r"[A-Za-z][\x{0300}-\x{0331}]"), F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")).otherwise(c)


def is_empty(c: Column) -> Column:
    """Null or the empty string."""
    return c.isNull() | (c == "")


def tidy(c: Column) -> Column:
    """Composed letters, no-break blanks as blanks, control and zero-width characters dropped, runs of blanks as one, ends trimmed."""
    plain = F.regexp_replace(F.translate(composed(c), "\u00a0", " "), "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f\u200b-\u200f\u2028\u2029\ufeff]", "")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n\x{2000}-\x{200a}\x{3000}]+", " "))


def is_placeholder(c: Column) -> Column:
    """Whether a text stands in for a missing value."""
    return F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def phone(c: Column, region: str = "US") -> Column:
    """E.164 where it can be told: numbers with a plus keep their digits, US numbers of 10 digits or 11 with the leading 1 get theirs; other numbers are their digits; null under 7 digits.

    Extensions are cut off. Without a table of numbering plans, numbers of other regions without a plus stay digits.
    """
    home = F.lit(region == "US")

    def told(p: Column) -> Column:
        raw, digits = p["raw"], p["digits"]
        us = F.when(home & (F.length(digits) == 10) & ~raw.startswith("+"), F.concat(F.lit("+1"), digits)).when((home | raw.startswith("+")) & (F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        return F.when(F.length(digits) < 7, None).otherwise(F.coalesce(us, F.when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)))

    bare = F.trim(F.regexp_replace(F.lower(c), r"[\s,;]*(ext\.?|x|extension)[ .]*[0-9]+\s*$", ""))
    return bind(bare, lambda raw: told(F.struct(raw.alias("raw"), F.regexp_replace(raw, "[^0-9]", "").alias("digits"))))


def phone_display(c: Column) -> Column:
    """``(512) 555-0182`` for US numbers, null for others and for numbers of one repeated digit or a sequence."""
    def shown(e: Column) -> Column:
        ten = F.substring(e, 3, 10)
        fake = ten.rlike(r"^(\d)\1*$") | ten.isin("1234567890", "0123456789", "0987654321") | ten.endswith("0000000")
        return F.when(e.rlike(r"^\+1[0-9]{10}$") & ~fake, F.concat(F.lit("("), F.substring(e, 3, 3), F.lit(") "), F.substring(e, 6, 3), F.lit("-"), F.substring(e, 9, 4)))

    return bind(phone(c), shown)


def email(c: Column) -> Column:
    """Mailbox identity: lower case, plus tags of known providers and the dots of some dropped; null if it is no address."""
    low = F.lower(F.trim(c))
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    cut = F.substring_index(local, "+", 1)
    local = F.when(domain.isin(*PLUS_TAG_DOMAINS) & (cut != ""), cut).otherwise(local)
    bare = F.replace(local, F.lit("."), F.lit(""))
    dotless = domain.isin(*DOTLESS_DOMAINS)
    local = F.when(dotless & (bare != ""), bare).otherwise(local)
    return F.when(low.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.concat(local, F.lit("@"), F.when(dotless, DOTLESS_DOMAINS[0]).otherwise(domain)))


def postal_code(c: Column) -> Column:
    """Five digits of a US postal code of 5 or 9 digits; other codes in upper case without blanks; null if empty."""
    bare = F.regexp_replace(c, r"[  ]", "")
    five = F.regexp_extract(bare, r"^([0-9]{5})(-?[0-9]{4})?$", 1)
    return F.when(bare == "", None).when(five != "", five).otherwise(F.upper(bare))


def restored_zip(c: Column) -> Column:
    """Five digits of a code that lost its leading zero or was stored as a number; null if it is none."""
    bare = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.when(bare.rlike("^[0-9]{3,5}$"), F.lpad(bare, 5, "0")).when(bare.rlike("^[0-9]{5}-?[0-9]{4}$"), F.substring(bare, 1, 5))


def words(c: Column) -> Column:
    """Words of a text, at white space."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _sorted_set(ws: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(ws)), " ")


def fingerprint(c: Column) -> Column:
    """Key collision key: sorted distinct words without accents, case and punctuation; punctuation inside a word joins its parts."""
    return _sorted_set(words(F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9_\s]", "")))


def ngram_fingerprint(c: Column, n: int = 2) -> Column:
    """Sorted distinct n-grams of the letters and digits."""
    s = F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(c.isNotNull(), F.array_join(F.array_sort(F.array_distinct(grams)), ""))


def company_key(c: Column) -> Column:
    """Sorted distinct words without legal forms; an ampersand is a word, other punctuation separates words."""
    return _sorted_set(F.filter(words(F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9_\s&]", " ")), lambda w: ~w.isin(*LEGAL_FORMS)))


def soundex(c: Column) -> Column:
    """Soundex of the letters a to z; empty if there is none."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def shape(c: Column) -> Column:
    """Coarse shape of a value: empty, currency, number, date, url or text."""
    t = F.trim(c)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.rlike(r"^[$€£¥] ?[0-9]"), "currency").when(t.rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?$"), "number")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(t.rlike("^https?://"), "url").otherwise("text")
    )


def redact(c: Column) -> Column:
    """E-mail addresses, telephone numbers and runs of nine or more digits replaced by marks."""
    no_mail = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    no_phone = F.regexp_replace(no_mail, r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[phone]")
    return F.regexp_replace(no_phone, "[0-9]{9,}", "[number]")


def mask(c: Column) -> Column:
    """A value for display: all but the first and the last two characters as dots; short values wholly."""
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.substring(c, 1, 1), F.repeat(F.lit("•"), n - 3), F.substring(c, -2, 2)))


def parse_decimal(c: Column) -> Column:
    """First number of a text, thousands commas dropped, as text."""
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?[0-9]+(\.[0-9]+)?)", 1)
    return F.when(found != "", found)


def canonical_url(c: Column) -> Column:
    """Host and path without scheme, www, fragment, tracking parameters and last slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"#.*$", ""), r"^[A-Za-z]+://", "")
    path, query = F.substring_index(bare, "?", 1), F.when(bare.contains("?"), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise(F.lit(""))
    host = F.regexp_replace(F.lower(F.substring_index(path, "/", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_replace(path, r"^[^/]*", ""), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.when(F.size(kept) > 0, F.concat(host, rest, F.lit("?"), F.array_join(kept, "&"))).otherwise(F.concat(host, rest))


def host_of(c: Column) -> Column:
    """Lower-case host of a URL."""
    return F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:]+)", 1))


#: name -> builder, for presets that name their transforms
TRANSFORMS = {f.__name__: f for f in (tidy, ascii_fold, compatible, phone, phone_display, email, postal_code, restored_zip, fingerprint, ngram_fingerprint, company_key, soundex, shape, redact, mask, parse_decimal, canonical_url, host_of)}

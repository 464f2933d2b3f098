"""What may be collected and what is kept: record checks, URL scope, robots rules, usage preferences, refusals."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import text as t
from rowloom.functions.transforms import host_under
from rowloom.operators.relational import first_by_key

# Phrases by which a server refuses automated readers.
REFUSALS = ("captcha", "are you a robot", "verify you are human", "unusual traffic", "access denied", "cf-challenge", "enable javascript and cookies to continue", "request blocked", "bot detection")


def record_errors(fields: Sequence[Mapping]) -> Column:
    """array<string> of what is wrong with a record: required, min_length, minimum, maximum, allowed_hosts of each field in order."""
    out = []
    for f in fields:
        c = F.col(f"`{f['name']}`")
        v = c.cast("string")
        gone = t.is_empty(v)
        if f.get("required"):
            out.append(F.when(gone, f"{f['name']} is required"))
        if f.get("min_length"):
            out.append(F.when(~gone & (F.length(v) < f["min_length"]), f"{f['name']} is too short"))
        figure = v.try_cast("double")
        if f.get("minimum") is not None:
            out.append(F.when(~gone & (figure < f["minimum"]), f"{f['name']} is below {f['minimum']}"))
        if f.get("maximum") is not None:
            out.append(F.when(~gone & (figure > f["maximum"]), f"{f['name']} is above {f['maximum']}"))
        if f.get("allowed_hosts"):
            out.append(F.when(~gone & ~t.host_of(v).isin(*f["allowed_hosts"]), f"{f['name']} is on another host"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def validate(records: DataFrame, fields: Sequence[Mapping], unique_by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records without errors, the first of each key, and the rejected ones with their errors. Records with an empty key part are never taken for copies."""
    checked = records.withColumn("errors", record_errors(fields))
    good = checked.where(F.size("errors") == 0).drop("errors")
    return (first_by_key(good, unique_by, order) if unique_by else good), checked.where(F.size("errors") > 0)


def in_scope(url: Column, hosts: Sequence[str], paths: Sequence[str] = ()) -> Column:
    """Whether a URL is https without credentials, on one of the hosts, and its path fits: a pattern that begins with ^ as a prefix, others in full."""
    path = F.when(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1) == "", "/").otherwise(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    fits = F.lit(not paths)
    for p in paths:
        fits = fits | path.rlike(p if p.startswith("^") else f"^(?:{p})$")
    return F.coalesce(url.rlike(r"^https://[^/@]+(/|$|\?|#)") & t.host_of(url).isin(*hosts) & fits, F.lit(False))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, agent, allow, pattern) of every rule of robots texts (host, text); a group's rules belong to each agent named above it."""
    lines = robots.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line"))
    lines = lines.select("host", "k", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where("line RLIKE '^[A-Za-z-]+ *:'")
    parts = lines.select("host", "k", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    # a robots text is one short document of a host: its lines are numbered within it
    seq = parts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "field", "value"))).alias("l"))
    first = F.aggregate("l", F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>").alias("rules")), lambda a, x: F.when(
        x["field"] == "user-agent", F.struct(F.when(a["open"], F.array_append(a["agents"], F.lower(x["value"]))).otherwise(F.array(F.lower(x["value"]))).alias("agents"), F.lit(True).alias("open"), a["rules"].alias("rules"))
    ).when(
        x["field"].isin("allow", "disallow"), F.struct(a["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(a["rules"], F.transform(a["agents"], lambda g: F.struct(g.alias("agent"), (x["field"] == "allow").alias("allow"), x["value"].alias("pattern")))).alias("rules"))
    ).otherwise(a))
    return seq.select("host", F.explode(first["rules"]).alias("r")).select("host", "r.agent", "r.allow", "r.pattern").where("pattern <> ''")


def _glob(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * for anything, $ for the end."""
    quoted = F.regexp_replace(pattern, r"([.+?(){}\[\]\\^|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url, ...) with allowed: the longest rule that fits the path decides, allow wins ties; an agent's own rules replace those of *."""
    own = rules.where(F.col("agent") == agent.lower()).select("host").distinct().withColumn("own", F.lit(True))
    mine = rules.join(own, "host", "left").where(F.when(F.col("own"), F.col("agent") == agent.lower()).otherwise(F.col("agent") == "*")).select("host", "allow", "pattern")
    at = urls.withColumns({"_host": t.host_of(F.col("url")), "_path": F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), "^$", "/")})
    hit = at.select("url", "_host", "_path").distinct().join(mine, F.col("_host") == F.col("host")).where(F.regexp_like(F.col("_path"), _glob(F.col("pattern"))))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allowed"))
    return at.join(best, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_host", "_path")


def reserved(location: Column, path: Column) -> Column:
    """Whether a rights reservation for a location covers a path: a pattern with *, or a prefix of whole parts."""
    return F.when(location.contains("*"), F.regexp_like(path, F.concat(_glob(location), F.lit("$")))).otherwise((path == location) | path.startswith(F.concat(F.rtrim(location, F.lit("/")), F.lit("/"))) | (location == "/"))


def content_usage(c: Column) -> Column:
    """map<string,string> of a usage preference header "train-ai=n, search=y"; later entries win."""
    pairs = F.filter(F.split(F.lower(c), r"[,;]"), lambda p: p.rlike(r"^\s*[a-z-]+\s*=\s*[a-z]+\s*$"))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring_index(p, "=", -1)).alias("v")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def refusal(status: Column, body: Column) -> Column:
    """Why a response is a refusal of automated readers: its status or a phrase of its text; null if it is none."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when(status.isin(401, 403, 407, 429, 451), F.concat(F.lit("status "), status.cast("string"))).otherwise(F.coalesce(*[F.when(low.contains(p), p) for p in REFUSALS]))


def changed_since(lastmod: Column, threshold: str | None) -> Column:
    """Whether a sitemap entry is new enough; with a threshold an entry without a date is not."""
    if threshold is None:
        return F.lit(True)
    return F.coalesce(F.try_to_date(F.substring(lastmod, 1, 10)) >= F.lit(threshold).cast("date"), F.lit(False))


def known_sites(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """urls with the site (domain, path_prefix, site) they belong to: the longest domain and path prefix; hosts meet domains by their own suffixes, so no pair is tried in vain."""
    host = t.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("domain")
    met = urls.select("url").distinct().select("url", suffix).join(sites, "domain")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    best = met.where(path.startswith(F.coalesce("path_prefix", F.lit("")))).groupBy("url").agg(F.max_by("site", F.struct(F.length("domain"), F.length(F.coalesce("path_prefix", F.lit(""))), "site")).alias("site"))
    return urls.join(best, "url", "left")


def bounded_query(query: str, cap: int) -> str:
    """A query text with LIMIT at most ``cap``: one that is missing is added, a larger one lowered."""
    found = re.search(r"(?i)\blimit\s+(\d+)", query)
    if not found:
        return f"{query.rstrip()} LIMIT {cap}"
    return query[: found.start(1)] + str(min(int(found[1]), cap)) + query[found.end(1) :]


__all__ = ["bounded_query", "changed_since", "content_usage", "host_under", "in_scope", "known_sites", "record_errors", "refusal", "reserved", "robots_allowed", "robots_rules", "validate"]

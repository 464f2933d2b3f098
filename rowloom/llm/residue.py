"""Problem 3: template residue, filler, error pages and script notices in collected records and warnings.

Every text of every element is cut into lines, and lines are counted in normalised form by host. A line that recurs on
a host beside ever different content, and gives nothing away itself, is that site's boilerplate (navigation, footers,
references) and is subtracted. An element is a case if the residual of any of its fields holds evidence: an unfilled
placeholder, a leftover script value, filler, an error page or a notice that scripts, cookies or another browser are
needed. Evidence that an honest text may hold too (a bare script value, a status number, a word of an error page) counts
only where it is the whole residual, so the counts decide it. A notice that recurs is a notice every time: lines with
evidence are never boilerplate.

Evidence is searched once per distinct line of a kind, whatever the number of hosts and elements that show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.runtime import Scratch, one_per

RECORD_FIELDS = ("title", "description", "price", "author", "source_url")

# Names of template fields, filler words, and the phrases of error pages and notices by language.
FIELD_NAMES = "name|title|price|count|date|year|city|street|sku|company|author|description|product|brand|category|email|phone|address|zip|country|quantity|url|image|user|username|item|id|value|text|amount|total"
LATIN_FILLER = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|laborum|"
    "nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est"
)
KEYBOARD_FILLER = "asdf+|asdfgh|qwerty|qwertz|bla+h?|test|x{3,}|a{3,}|foo|foobar|dummy|placeholder|xyz+"
HTTP_PHRASES = "not found|page not found|forbidden|gone|bad gateway|bad request|gateway time-?out|service unavailable|service temporarily unavailable|internal server error|too many requests|unauthori[sz]ed|access denied|request timeout"
WHOLE_LINES = (
    "session expired|just a moment(\\.\\.\\.|…)?|loading(\\.\\.\\.|…)?|please wait(\\.\\.\\.|…)?|browser check|site under maintenance|under maintenance|oops!? something went wrong|something went wrong|unsupported browser|cookies required|javascript required|"
    "javascript is (disabled|required|off)|enable (javascript|cookies|scripts|js)|texto de ejemplo|hier steht ein beispieltext|beispieltext|texte d.exemple|texte ici|your (text|headline|title|description|copy|name|content) here|(sample|dummy|placeholder) text|tbd|"
    "seite nicht gefunden|zugriff verweigert|página no encontrada|acceso denegado|page introuvable|accès refusé|страница не найдена|找不到页面|页面不存在|ページが見つかりません|الصفحة غير موجودة|पृष्ठ नहीं मिला|ไม่พบหน้า"
)
PHRASES = (
    "(page|document|item|listing|file|resource|product) you (requested|are looking for|asked for|were looking for)\\b.{0,20}(has moved|was removed|was moved|does not exist|could not be found|cannot be found|no longer exists|is not available)",
    "you do not have permission to (view|access|see)", "your session has expired", "log in again to continue", "we will be back soon", "(shop|site|store|page) is (closed|down|offline) for maintenance",
    "^we are sorry, (the service|something|an unexpected)", "an unexpected error occurred", "please try again (later|in a few (minutes|seconds|moments))\\W*$", "traceback \\(most recent call last\\)", "fatal error: uncaught", "uncaught (exception|typeerror|referenceerror)",
    "^sql error \\d+", "syntax error near", "checking (that|if|whether) your browser", "(goes|go) here\\W*$", "^(item|example|product|sample|demo|test|dummy) (title|text|copy|description|headline|name) \\d+\\W*$", "^type your \\w+ here", "^todo: ?(write|add|fill)", "\\[object object\\]",
    "(enable|allow|turn on|activate|switch on)\\b.{0,30}\\b(javascript|js|scripts|cookies)\\b", "\\b(needs|requires|does not work without|cannot work without)\\b.{0,12}\\b(javascript|js|scripts|cookies)\\b", "your browser is (not supported|out of date|too old)", "scripts could not be loaded", "(javascript|scripts|cookies) (is|are) (disabled|turned off|blocked)",
    "schalten sie (javascript|skripte|cookies)", "aktivieren sie (bitte )?(javascript|skripte|cookies)", "(activer|activez) (javascript|les cookies|les scripts)", "(active|activa|habilite|habilita) (javascript|las cookies|los scripts)", "(включите|разрешите) (javascript|скрипты|cookie)", "(启用|开启)(脚本|javascript|cookie)", "(javascript|スクリプト|cookie)を有効",
    "gewünschte seite existiert nicht", "el servicio no está disponible", "la page demandée n.existe plus", "запрашиваемая страница", "お探しのページは", "您访问的页面", "la página (solicitada|que busca) no existe",
)

PLACEHOLDER = (
    r"\{\{\{?\s*[\w.]+\s*\}?\}\}|\$\{\s*[\w.]+\s*\}|<%=?\s*[\w.]+\s*%>|\{%\s*\w+[^%]*%\}|\[\[\s*[\w .]+\s*\]\]|__[A-Za-z][A-Za-z_]*[A-Za-z]__|@@\w+@@|%[A-Z][A-Z_]{2,}%|%\(\w+\)[sdSD]|(?<![\w%])%[sdS](?!\w)"
    r"|#[A-Z][A-Z_]{2,}#|\$[A-Z][A-Za-z]{2,}\$|(?i:\[(insert|your|enter|add) [^\]]*\])|(?i:\{(\d|" + FIELD_NAMES + r"|[a-z]+_[a-z_]+)\})"
)
#: navigation that pages append to a message
CHROME = r"(?i)\s+(ref(erence)? [0-9a-f-]+|request id [0-9a-f-]+|go to the start page|back to home|contact support|reload|\(c\) \d{4}|© ?\d{4})\W*$"
#: a text that explains placeholders or filler is about them
ABOUT = r"(?i)mail merge|\bsyntax\b|style guide|\btutorial\b|\bessay on\b|\bhandbook\b|\bteaches\b|such as lorem ipsum"


def _lines(text: Column) -> Column:
    """Lines of a text: tags, notice marks and the name of the site taken off, cut at line ends and after sentence ends."""
    bare = F.regexp_replace(F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>", " "), r"[\r\n]+|(?<=[.!?。！？…])\s+", "\u0001")
    return F.filter(F.transform(F.split(bare, "\u0001"), lambda x: F.trim(F.regexp_replace(x, r"^\s*((?i:notice|error|warning|hinweis):\s+|!\s+)+", ""))), lambda x: x != "")


def _plain(line: Column) -> Column:
    """A line without appended navigation and without the name of its site."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, CHROME, ""), r"^[\p{L}]+ \| ", ""), r" [-|–] [\p{L}]+$", ""))


def _evidence(line: Column, plain: Column, about: Column, part: Column) -> tuple[Column, Column]:
    """What a line gives away wherever it stands, and what it gives away only as the whole residual of its field; null if nothing. part: title, source_url or another field."""
    url = part == "source_url"
    open_mark = F.when(line.rlike(PLACEHOLDER) & ~about, "placeholder")
    anywhere = (
        F.when(plain.rlike(rf"(?i)^(\W*({LATIN_FILLER})\b){{2,}}\W*$") | plain.rlike(rf"(?i)^(\W*\b({KEYBOARD_FILLER})\b)+\W*$"), "filler")
        .when(plain.rlike(rf"(?iu)^({WHOLE_LINES})\W*$"), "notice")
        .when(plain.rlike(rf"(?i)^((error|fehler|erreur|ошибка)\W*)?\d{{3}}\W*({HTTP_PHRASES})?\W*$") & plain.rlike(r"(?i)[a-zа-я]"), "error page")
        .when(plain.rlike(rf"(?i)^(({HTTP_PHRASES})\W*(\d{{3}})?|(error|fehler|erreur|ошибка)\W*\d{{3}})\W*$"), "error page")
        .when(plain.rlike("(?iu)" + "|".join(f"({p})" for p in PHRASES)), "notice")
    )
    whole = F.when(line.rlike(r"^\$?\s*(undefined|NaN|null|None|\[object Object\]|-?Infinity)$"), "script value").when((part == "title") & plain.rlike(r"^[45]\d\d$"), "error page")
    return F.coalesce(open_mark, F.when(~url & ~about, anywhere)), F.when(~url & ~about, whole)


def _elements(runs: DataFrame) -> DataFrame:
    """(run_id, host, field_name, item_pos, part, text) of every text of every element; rows repeated under one run_id count once."""
    host = F.coalesce(F.regexp_extract("source_url", r"^[a-z]+://([^/]+)", 1), F.lit(""))
    base = one_per(runs.select("run_id", host.alias("host"), "records", "warnings"), ["run_id"])
    record = base.select("run_id", "host", F.lit("records").alias("field_name"), F.posexplode("records").alias("item_pos", "r")).where("r IS NOT NULL")
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("part"), F.col(f"r.{f}").alias("text")) for f in RECORD_FIELDS])).alias("t")
    record = record.select("run_id", "host", "field_name", "item_pos", texts).select("run_id", "host", "field_name", "item_pos", "t.part", "t.text")
    warning = base.select("run_id", "host", F.lit("warnings").alias("field_name"), F.posexplode("warnings").alias("item_pos", "text")).select("run_id", "host", "field_name", "item_pos", F.lit("warning").alias("part"), "text")
    return record.unionByName(warning).where("text IS NOT NULL")


def residue(runs: DataFrame, *, share: float = 0.02, beside: int = 3) -> DataFrame:
    """(run_id, field_name, item_pos, evidence) of every element of ``records`` and ``warnings`` that holds residue in place of content.

    runs: scrape_result; further columns are ignored. A line without evidence is a host's boilerplate if it stands beside
    at least ``beside`` different neighbours, is never a field by itself, and makes up a ``share`` of the host's fields.
    Null arrays, elements and fields and blank texts hold nothing; rows repeated under one run_id count once; null hosts
    are counted together. The evidence given is the first by alphabet if an element shows several kinds.
    """
    scratch = Scratch(runs.sparkSession)
    shape = F.lower(F.regexp_replace("line", r"\d+", "0"))
    kind = F.when(F.col("part").isin("title", "source_url"), F.col("part")).otherwise("text")
    fields = _elements(runs).withColumn("lines", _lines(F.col("text"))).where(F.size("lines") > 0)
    line = scratch.cut(fields.select("run_id", "host", "field_name", "item_pos", "part", kind.alias("kind"), F.size("lines").alias("of"), F.posexplode("lines").alias("k", "line"), F.xxhash64("lines").alias("beside")))
    # each distinct line is looked at once; what is needed several times is made in its own step
    distinct = scratch.cut(line.select("kind", "line").distinct().select("kind", "line", F.explode(F.array(F.struct(_plain(F.col("line")).alias("plain"), F.col("line").rlike(ABOUT).alias("about")))).alias("p")).select("kind", "line", "p.plain", "p.about"))
    anywhere, whole = _evidence(F.col("line"), F.col("plain"), F.col("about"), F.col("kind"))
    judged = scratch.cut(distinct.select("kind", "line", anywhere.alias("anywhere"), whole.alias("whole")).where("anywhere IS NOT NULL OR whole IS NOT NULL"))
    scratch.drop(distinct)
    sure = line.join(judged.where("anywhere IS NOT NULL"), ["kind", "line"]).select("run_id", "field_name", "item_pos", F.col("anywhere").alias("evidence"))
    # what counts only as the whole residual: fields whose other lines are all boilerplate
    maybe = line.join(judged.where("anywhere IS NULL"), ["kind", "line"]).select("run_id", "host", "field_name", "item_pos", "part", "of", "k", F.col("whole").alias("evidence"))
    bare = maybe.where("of = 1").select("run_id", "field_name", "item_pos", "evidence")
    beside_it = maybe.where("of > 1")
    counted = line.groupBy("host", shape.alias("shape")).agg(F.count("*").alias("n"), F.min("of").alias("least"), F.approx_count_distinct("beside", 0.05).alias("different"))
    size = fields.groupBy("host").agg(F.count("*").alias("fields"))
    plain_shapes = counted.where((F.col("least") > 1) & (F.col("different") >= beside)).join(size, "host").where(F.col("n") >= share * F.col("fields")).select("host", "shape", F.lit(True).alias("boilerplate"))
    others = line.where("of > 1").join(beside_it.select("run_id", "field_name", "item_pos", "part").distinct(), ["run_id", "field_name", "item_pos", "part"], "left_semi").withColumn("shape", shape).join(plain_shapes, ["host", "shape"], "left")
    left = others.groupBy("run_id", "field_name", "item_pos", "part").agg(F.count_if(F.col("boilerplate").isNull()).alias("left"))
    rest = beside_it.join(left.where("left <= 1"), ["run_id", "field_name", "item_pos", "part"]).select("run_id", "field_name", "item_pos", "evidence")
    found = sure.unionByName(bare).unionByName(rest)
    return found.groupBy("run_id", "field_name", "item_pos").agg(F.min("evidence").alias("evidence"))

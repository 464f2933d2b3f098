"""Problem 10: sentence units of texts in many languages and scripts, with unsupervised statistics per language.

One pass over all texts counts, by language, how often each word is written with and without a final period, which
words follow a period, in which case words stand inside sentences, and, for scripts that end no sentence with a mark,
which word beginnings open a line. Log-likelihood ratios over these counts give the abbreviations, the sentence
starters and the collocations (an ordinal number and its noun, a word and the figures that follow its period). An entry
must make up a share of its language's words, so the lists are bounded by the share and not by the corpus; they travel
to the second pass, which classifies every period (and, in Thai, every space) with them. Quotations and brackets of any
length are stepped over as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.runtime import Scratch

# Frequent words by which a Latin paragraph shows its language, marks of list entries, quotes and brackets.
COMMON = {
    "en": "the of and to was in is that for with from by are row this on it an before after each out at",
    "de": "der die das und ist nicht von mit den dem wurde eine ein im zu auf aus für zeile wird vom zur",
    "fr": "le les des est une du et dans pour par avec pas ce ligne reste aux cette au sur ont été",
    "es": "el los las del es una y con para esta fila lo al por se fue su como",
}
OPEN = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】"}
CLOSERS = "\"”’»)]}」』）】》“"
ENDS = ".!?…。！？؟।॥۔｡"
_BREAK = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]")
_LIST = re.compile(r"\s*(?:[-*•·‣▪–—+]|\d{1,3}[.)]|[a-zA-Z][.)])[ \t]+\S")
_WORD = re.compile(r"\S+")
_STRIP = "\"“”„«»‘’'()[]{}「」『』（）,;:¿¡*"
_LATIN = {w: k for k in reversed(COMMON) for w in COMMON[k].split()}


_SCRIPTS = {k: re.compile(f"[{v}]+") for k, v in {"ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff", "th": "\u0e00-\u0e7f", "hi": "\u0900-\u097f", "ar": "\u0600-\u06ff", "ru": "\u0400-\u04ff", "ko": "\uac00-\ud7a3"}.items()}
_LETTERS = re.compile(r"[^\W\d_]+")


def language(text: str, given: str | None) -> str:
    """Language of a stretch of text: by script, in Latin by its frequent words, else as given."""
    if not text.isascii():
        counts = {k: sum(map(len, r.findall(text))) for k, r in _SCRIPTS.items()}
        if counts["ja"] and counts["ja"] * 8 >= counts["zh"]:
            return "ja"
        best = max(counts, key=counts.__getitem__)
        if counts[best] and counts[best] * 5 >= len(text) - text.count(" "):
            return best
    votes = Counter(_LATIN[w] for w in _LETTERS.findall(text.lower()) if w in _LATIN)
    if votes and votes.most_common(1)[0][1] >= 2:
        return votes.most_common(1)[0][0]
    given = (given or "").split("-")[0].lower()
    return given if given in COMMON else (votes.most_common(1)[0][0] if votes else "en")


def _apart(text: str, s: int, e: int) -> bool:
    """A list entry or a line of a table: never a part of running text."""
    line = text[s:e].strip()
    cells = re.split(r"[,;|\t]", line)
    return bool(_LIST.match(text, s, e)) or (len(cells) >= 3 and len(line.split()) <= len(cells) and not line.endswith("."))


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of every stretch that is segmented by itself; whole: it is one unit (a list entry)."""
    lines, at = [], 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    groups: list[list[tuple[int, int]]] = [[]]
    for s, e in lines:
        if text[s:e].strip():
            groups[-1].append((s, e))
        elif groups[-1]:
            groups.append([])
    # hard-wrapped: lines are filled to a width, so that the next word would not have fitted, or broken at the first blank beyond one
    running = [[ln for ln in g if not _apart(text, *ln)] for g in groups]
    filled = [(text[s:e].rstrip(), text[s2:e2].split(None, 1)[0]) for g in running for (s, e), (s2, e2) in zip(g, g[1:], strict=False) if e <= s2 <= e + 2]
    wrapped = False
    if filled:
        width = max(e - s for g in running if len(g) > 1 for s, e in g)
        short = sorted(len(a) for a, _ in filled)[len(filled) // 20]
        fits = sum(len(a) + 1 + len(w) <= width for a, w in filled)
        over = sum(len(a) < short or len(a) - len(a.split()[-1]) - 1 >= short for a, _ in filled)
        broken = sum(a[-1] not in ENDS + CLOSERS + ":" for a, _ in filled)
        wrapped = broken > 0 and 40 <= short and width <= 130 and min(fits, over) <= 0.05 * len(filled)
    for g in groups:
        if not g:
            continue
        if not wrapped:
            for s, e in g:
                yield s, e, bool(_LIST.match(text, s, e))
            continue
        start = 0
        while start < len(g) and _apart(text, *g[start]):
            yield g[start][0], g[start][1], bool(_LIST.match(text, *g[start]))
            start += 1
        if start < len(g):
            yield g[start][0], g[-1][1], False


@lru_cache(maxsize=1 << 17)
def _norm(word: str) -> str:
    return unicodedata.normalize("NFC", word.lower())


_FEW_DIGITS = re.compile(r"\d{1,2}")
_FIGURES = re.compile(r"[\d.,:/–-]+%?")


@lru_cache(maxsize=1 << 17)
def _kind(token: str) -> str:
    """Type of a word before a period: lower case, numbers as classes."""
    t = _norm(token).strip(_STRIP)
    return "#2" if _FEW_DIGITS.fullmatch(t) else "#" if _FIGURES.fullmatch(t) else t


def _closings(text: str, s: int, e: int, c: str) -> dict[int, int]:
    """Position of the closing mark of every opening mark c between s and e that has one, in one pass."""
    close, out, stack = OPEN[c], {}, []
    for m in re.compile(f"[{re.escape(c + close)}]").finditer(text, s, e):
        i, d = m.start(), m[0]
        if d in close and stack and not (c == "‘" and text[i + 1 : i + 2].isalpha()):
            if c in '"„':  # no nesting: all that wait for a mark get this one
                for j in stack:
                    out[j] = i
                stack = []
            else:
                out[stack.pop()] = i
        if d == c and (d not in close or c == '"') and not (c == '"' and i + 1 < e and text[i + 1].isspace()):
            stack.append(i)
    return out


@lru_cache(maxsize=1 << 17)
def _look(w: str) -> tuple[str, str, str, bool, bool, str]:
    """What the statistics need of a written word: (core, its kind, its normal form, ends a sentence, has a plain period, case)."""
    bare = w.strip(_STRIP)
    core = bare.rstrip(".…!?")
    dotted = bare.endswith(".") and not bare.endswith("..") and w[-1] not in CLOSERS
    case = ("lower" if core[0].islower() else "upper") if core and core[0].isalpha() else ""
    return core, _kind(core) if core else "", _norm(core), bool(bare) and bare[-1] in ENDS, dotted, case


@lru_cache(maxsize=1 << 17)
def _follower(w: str) -> str:
    nxt = w.strip(_STRIP).rstrip(".,!?…")
    return nxt and ("U" if nxt[0].isupper() else "l" if nxt[0].islower() else "0") + _norm(nxt)


def observe(texts: list[tuple[str | None, str | None]]) -> Counter:
    """Counts for the statistics: (language, what, a, b) of a batch of (text, lang)."""
    n: Counter = Counter()
    for text, given in texts:
        for s, e, whole in blocks(text or ""):
            if whole:
                continue
            seg = text[s:e]
            lang = language(seg, given)
            words = _WORD.findall(seg)
            keys = []
            if lang == "th":
                n.update((lang, "open" if k == 0 else "inner", w[:4], "") for k, w in enumerate(words) if "฀" <= w[0] <= "๿")
                continue
            before, last = "^", len(words) - 1
            for k, w in enumerate(words):
                core, kind, norm, stop, dotted, case = _look(w)
                if not core:
                    before = "^" if stop else before
                    continue
                if dotted:
                    keys.append((lang, "period", kind, ""))
                    if k < last and (nxt := _follower(words[k + 1])):
                        keys.append((lang, "after", kind, nxt))
                else:
                    keys.append((lang, "plain", kind, ""))
                # the case of words that do not follow any mark
                if not before and case:
                    keys.append((lang, case, norm, ""))
                if k == 0:
                    keys.append((lang, "first", norm, ""))
                before = "^" if stop or w[-1] in ":" + CLOSERS else ""
            n.update(keys)
    return n


_NEXT = re.compile(r"\s*(\S+)")
_DOTTED = re.compile(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = re.compile("[" + re.escape("".join(OPEN) + ENDS) + "]")
_THAI_GAP = re.compile(r"\s+(\S)")
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}$")
_GLUED = re.compile(r"[^\W\d_]+(?:[,.!?;:]|$)")
_NO_WORD = re.compile(r"[/@_\d]")
_NOT_BLANK = re.compile(r"\S*")
_FIGURE_IN = re.compile(r"[\d_]")


class Model:
    """The short lists of one corpus: abbreviations, words that open a sentence after one, and openers of Thai sentences."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.abbr = {(a, b) for a, k, b in rows if k == "abbr"}
        self.starts = {(a, b) for a, k, b in rows if k == "starts"}
        self.ordinal = {(a, b) for a, k, b in rows if k == "ordinal"}
        self.number = {(a, b) for a, k, b in rows if k == "number"}
        self.opens = {(a, b) for a, k, b in rows if k == "opens"}

    def ends_at(self, text: str, s: int, i: int, e: int, lang: str) -> bool:
        """Whether the period at i, followed by white space, ends a sentence."""
        j = i
        while j > s and not text[j - 1].isspace() and text[j - 1] not in "([«“„「（":
            j -= 1
        token = text[j:i].strip(_STRIP)
        m = _NEXT.match(text, i + 1, e)
        if not m:
            return True
        raw = m[1]
        nxt = raw.strip(_STRIP).rstrip(".,!?…")
        first = nxt[:1] or raw[:1]
        if not token:
            return not first.islower()
        kind = _kind(token)
        key = (lang, _norm(nxt))
        if first.islower() and not _FIGURE_IN.search(nxt):
            return False
        if first.isdigit() and (lang, kind) in self.number:
            return False
        if kind == "#2" or kind == "#":
            if kind == "#2" and (lang, _norm(nxt)) in self.ordinal:
                return False
            return True
        dotted = _DOTTED.fullmatch(token) is not None
        if _LETTER.fullmatch(token) and token.isupper() or dotted or (lang, kind) in self.abbr:
            if first.isdigit() or raw[0] in "§#&+":
                return False
            if raw[0] in OPEN and not first.isupper():
                return False
            if not (first.isupper() or first.islower()):
                return False
            return key in self.starts
        return True

    def units(self, text: str | None, given: str | None) -> list[tuple[int, int]]:
        """Start and end of every sentence unit."""
        out: list[tuple[int, int]] = []
        for s, e, whole in blocks(text or ""):
            cuts = [] if whole else self._cuts(text, s, e, language(text[s:e], given))
            for a, b in zip([s, *cuts], [*cuts, e], strict=True):
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((a, b))
        return out

    def _cuts(self, text: str, s: int, e: int, lang: str) -> list[int]:
        cuts = []
        if lang == "th":
            for m in _THAI_GAP.finditer(text, s, e):
                k = m.start(1)
                if ("th", text[k : k + 4].split()[0]) in self.opens or text[m.start() - 1] in "!?" and m.start() > s:
                    cuts.append(k)
            return cuts
        i = s
        closing: dict[str, dict[int, int]] = {}
        while m := _MARKS.search(text, i, e):
            i = m.start()
            c = text[i]
            if c in OPEN and (c not in "\"'‘»" or i == s or not text[i - 1].isalnum()):
                if c not in closing:
                    closing[c] = _closings(text, s, e, c)
                j = closing[c].get(i, -1)
                if j > 0:
                    inner = text[j - 1]
                    i = j + 1
                    # a quotation or bracket that holds its own end: the sentence goes on unless a new one begins after it
                    if inner in ENDS and i < e and text[i].isspace():
                        m = _NEXT.match(text, i, e)
                        word = m[1].lstrip(_STRIP) if m else ""
                        if m and (word[:1].isupper() or word[:1].isdigit() or (m[1][0] in OPEN and not word[:1].islower()) or not word) and not self._speech(word, text, m.end(), lang):
                            cuts.append(i)
                    continue
            if c not in ENDS:
                i += 1
                continue
            j = i
            while j < e and text[j] in ENDS:
                j += 1
            k = j
            while k < e and text[k] in CLOSERS and not (text[k] in '"“' and k + 1 < e and text[k + 1].isalnum()):
                k += 1
            if k >= e:
                break
            run = text[i:j]
            if run[-1] in "。！？｡" or run[0] in "。！？｡" or (run.startswith("…") and lang in ("zh", "ja")):
                if text[k] not in "，、；：,)）":
                    cuts.append(k)
            elif text[k].isspace():
                nxt = _NEXT.match(text, k, e)
                first = nxt[1].lstrip(_STRIP)[:1] if nxt else ""
                if run == ".":
                    if self.ends_at(text, s, i, e, lang) if k == j else not first.islower():
                        cuts.append(k)
                elif nxt and not first.islower():
                    cuts.append(k)
            elif run == "." and k == j and text[k].isupper() and _TWO_LETTERS.search(text[max(s, i - 2) : i]) and text[i - 1].islower():
                # a blank was forgotten: a lower-case word, a period, and a capitalised word
                a = max(text.rfind(" ", s, i), text.rfind("\n", s, i)) + 1
                b = _NOT_BLANK.match(text, k, e).end()
                if not _NO_WORD.search(text[a:i]) and _GLUED.match(text[k:b]) and (lang, _kind(text[a:i])) not in self.abbr:
                    cuts.append(k)
            elif run[-1] in "!?؟" and k == j and text[k].isupper() and "/" not in text[max(text.rfind(" ", s, i), s) : i]:
                cuts.append(k)
            i = max(k, j)
        return cuts

    def _speech(self, word: str, text: str, end: int, lang: str) -> bool:
        """Whether a capitalised word after a quotation is the speaker's name: in scripts without case the verb follows it."""
        return lang in ("hi", "ar") and word[:1].isascii()


def _llr(k: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio of a pair seen k times, its parts a and b times, among n pairs (Dunning); 0 where it is rarer than chance."""

    def part(x: Column, rows: Column, cols: Column) -> Column:
        return F.when(x > 0, x * F.log(x * n / (rows * cols))).otherwise(0.0)

    k, a, b, n = (c.cast("double") for c in (k, a, b, n))
    g = 2 * (part(k, a, b) + part(a - k, a, n - b) + part(b - k, n - a, b) + part(n - a - b + k, n - a, n - b))
    return F.when(k * n > a * b, g).otherwise(0.0)


def learn(documents: DataFrame, scratch: Scratch, *, least_share: float = 1e-6, least_llr: float = 7.88) -> list[tuple[str, str, str]]:
    """(language, list, entry) of the model, from counts over all texts.

    The lists hold what is significant (``least_llr``, 0.5 % of chance) and makes up ``least_share`` of the words of its
    language or was seen twice in a small one: at most 1 / least_share entries of a kind and language, whatever the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = observe(list(zip(batch["text"], batch["lang"], strict=True)))
            if n:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["language", "what", "a", "b", "n"])

    raw = documents.mapInPandas(count, "language string, what string, a string, b string, n long")
    counts = scratch.cut(raw.groupBy("language", "what", "a", "b").agg(F.sum("n").alias("n")))
    word = counts.where("b = ''").groupBy("language", "a").pivot("what", ["period", "plain", "lower", "upper", "open", "inner", "first"]).agg(F.sum("n")).na.fill(0)
    total = counts.where("what IN ('period', 'plain')").groupBy("language").agg(F.sum(F.when(F.col("what") == "period", F.col("n"))).alias("periods"), F.sum("n").alias("words"))
    after = counts.where("what = 'after'").select("language", "a", F.substring("b", 1, 1).alias("case"), F.expr("substring(b, 2)").alias("next"), "n")
    # the words that open lines again and again: what they follow may well be the end of a sentence
    lines = counts.where("what = 'first'").groupBy("language").agg(F.sum("n").alias("lines"))
    openers = word.join(lines, "language").where("first >= 3 AND first >= 0.001 * lines").select("language", F.col("a").alias("next"), F.lit(True).alias("opener"))
    after = after.join(openers, ["language", "next"], "left").na.fill(False, ["opener"])
    small = after.groupBy("language", "a").agg(F.sum("n").alias("inside"), F.sum(F.when(F.col("case") == "l", F.col("n")).otherwise(0)).alias("small"), F.sum(F.when((F.col("case") == "0") & F.col("next").rlike("^[0-9]"), F.col("n")).otherwise(0)).alias("figures"), F.sum(F.when((F.col("case") == "0") | ((F.col("case") == "U") & ~F.col("opener")), F.col("n")).otherwise(0)).alias("digit"))
    typed = word.where("period > 0 AND NOT a LIKE '#%'").join(total, "language").join(small, ["language", "a"], "left").na.fill(0, ["inside", "small", "digit"])

    # log-likelihood ratio of "always with a period" against chance, weighed by length, inner periods and rivals without period
    n, p = F.col("period") + F.col("plain"), F.col("period")
    q = F.least(F.greatest(F.col("periods") / F.col("words"), F.lit(1e-9)), F.lit(1 - 1e-9))
    llr = 2 * (p * F.log(F.lit(0.99) / q) + F.col("plain") * F.log(F.lit(0.01) / (1 - q)))
    size = F.length(F.regexp_replace("a", r"\.", ""))
    dots = F.length("a") - size + 1
    score = llr * F.exp(-size.cast("double")) * dots * F.pow(F.greatest(size, F.lit(1)).cast("double"), -F.col("plain").cast("double"))
    # what is followed by lower-case words, figures or names does not end sentences; words at the end of sentences are followed by words that open them
    carries = (F.col("small") + F.col("digit")) / F.greatest(F.col("inside"), F.lit(1))
    frequent = F.greatest(F.lit(2.0), least_share * F.col("words"))
    abbr = typed.where(((score >= 0.3) & (n >= 3)) | ((carries >= 0.25) & (F.col("small") >= 2) & (p >= 5 * F.col("plain"))))
    abbr = abbr.where((p > F.col("plain")) & (carries >= 0.25) & (n >= frequent)).select("language", "a")

    # sentence starters: capitalised words that follow the period of a plain word significantly more often than chance, or that stand in lower case inside sentences
    initial = F.col("a").rlike(r"^[^0-9_#]$|^([^0-9_.#]{1,3}\.)+[^0-9_.#]{1,3}$")
    follows = after.where("case = 'U' AND NOT a LIKE '#%'").where(~initial)
    capital = follows.join(abbr, ["language", "a"], "left_anti").groupBy("language", "next").agg(F.sum("n").alias("opened"))
    breaks = capital.groupBy("language").agg(F.sum("opened").alias("breaks"))
    cased = word.select("language", F.col("a").alias("next"), "lower", "upper", (F.col("period") + F.col("plain")).alias("seen"))
    starts = cased.join(capital, ["language", "next"], "left").na.fill(0, ["opened"]).join(total, "language").join(breaks, "language")
    starter = _llr(F.col("opened"), F.col("breaks"), F.col("seen"), F.greatest(F.col("words"), F.col("seen") + F.col("breaks")))
    starts = starts.where(((F.col("lower") >= frequent) & (F.col("lower") > F.col("upper"))) | ((starter >= least_llr) & (F.col("opened") >= frequent) & (F.col("opened") >= 0.5 * F.col("seen")))).where("opened >= 1 OR lower >= 3")
    # only what follows an abbreviation, an initial or a dotted form is ever asked about
    short = after.where("case = 'U'").where(initial).select("language", "next")
    asked = after.where("case = 'U'").join(abbr, ["language", "a"], "left_semi").select("language", "next").unionByName(short).distinct()
    starts = starts.join(asked, ["language", "next"], "left_semi").join(abbr.withColumnRenamed("a", "next"), ["language", "next"], "left_anti")
    # collocations of ordinals: a capitalised word that goes with a one- or two-figure number and a period significantly more often than with other periods
    pairs = after.where("case = 'U'").groupBy("language").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("a") == "#2", F.col("n")).otherwise(0)).alias("numbers"))
    ordinal = after.where("a = '#2' AND case = 'U'").groupBy("language", "next").agg(F.sum("n").alias("k")).join(capital, ["language", "next"], "left").na.fill(0, ["opened"]).join(pairs, "language").join(total, "language")
    ordinal = ordinal.where((_llr(F.col("k"), F.col("numbers"), F.col("k") + F.col("opened"), F.greatest(F.col("all"), F.col("numbers") + F.col("k") + F.col("opened"))) >= least_llr) & (F.col("k") >= frequent) & (F.col("k") > 2 * F.col("opened")))
    opens = word.where("open >= 2 AND open >= 0.03 * (open + inner)")
    # collocations of figures: words whose period stands before figures significantly more often than other periods do, though the word itself may be common without it
    figure = small.groupBy("language").agg(F.sum("inside").alias("all"), F.sum("figures").alias("every"))
    number = small.where("NOT a LIKE '#%'").join(figure, "language").join(total, "language").where((_llr(F.col("figures"), F.col("inside"), F.col("every"), F.col("all")) >= least_llr) & (F.col("figures") >= frequent) & (F.col("figures") >= 0.6 * F.col("inside")))
    number = number.select("language", F.lit("number").alias("k"), "a")
    lists = (
        number.unionByName(abbr.select("language", F.lit("abbr").alias("k"), "a")).unionByName(starts.select("language", F.lit("starts").alias("k"), F.col("next").alias("a")))
        .unionByName(ordinal.select("language", F.lit("ordinal").alias("k"), F.col("next").alias("a"))).unionByName(opens.select("language", F.lit("opens").alias("k"), "a"))
    )
    return [tuple(r) for r in lists.collect()]


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit, in Unicode code points, end exclusive, without surrounding white space.

    documents: (doc_id, text, lang); further columns are ignored. Null, empty and blank texts have no unit; a missing
    or wrong lang only matters for Latin paragraphs without any frequent word; repeated rows are segmented each;
    a text of any length is one row, read whole.
    """
    scratch = Scratch(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    base = documents.select("doc_id", "text", "lang").where("text IS NOT NULL AND text <> ''")
    model = Model(learn(base.select("text", "lang"), scratch))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = shared.value.units
        for batch in batches:
            out = [(d, a, b) for d, t, g in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True) for a, b in units(t, g)]
            yield pd.DataFrame(out, columns=["doc_id", "start_char", "end_char"])

    return base.mapInPandas(run, f"doc_id {kind}, start_char int, end_char int")

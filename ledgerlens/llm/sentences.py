"""Sentence units of texts in many languages and scripts.

Abbreviations, collocations and sentence starters are learned per language from all documents by
log-likelihood ratios (Dunning, as Kiss and Strunk use them); every full stop is then classified by
these statistics. In formulaic corpora some ordinary words always end a sentence, so an abbreviation must
also continue a line more often than sentence ends do. Scripts without full stops use their own end
marks; in Thai, where a space may or may not end a sentence, chunks that open lines are learned instead.

Defined results: null and blank texts have no units; a text without marks is one unit per line block;
repeated documents give repeated units; an empty corpus gives an empty model and no rows. Offsets count
code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, broadcast_if_small, shared_checkpoint, spread

ENDERS = ".!?。！？…।|؟｡．"
HARD = "!?。！？।|؟｡．"
OPEN = {"“": "”", "«": "»", "(": ")", "（": "）", "「": "」", "『": "』", "„": "“", "[": "]", "‘": "’"}
CLOSE = set("”»)）」』]’")
BULLETS = "•*-–—·‣▪◦"
MOST_MODEL, MOST_LANGUAGES = 400_000, 200_000
HEADING_CHARS = 70
_APART = frozenset("\"“”„«»()[]{}（）「」『』")
_TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{}（）「」『』]+")
_PAIRED = re.compile(r"[“”„«»()（）「」『』\[\]\"]")
_MARK = re.compile(r"[.!?。！？…।|؟｡．“”„«»()（）「」『』\[\]\"]")
_STOPS, _LAST_WORD, _NEXT_WORD = re.compile(r"[.!?。！？…।|؟｡．]+"), re.compile(r"[^\s\"“”„«»()\[\]{}（）「」『』]+$"), re.compile(r"[^\s\"“”„«»()\[\]{}（）「」『』]+")
_LETTER = re.compile(r"[^\W\d_]")


# Scripts by their letters; kana weighs more than the Han characters that Japanese shares.
_SCRIPTS = {"th": ("\u0e00-\u0e7f", 1), "hi": ("\u0900-\u097f", 1), "ar": ("\u0600-\u06ff", 1), "ja": ("\u3040-\u30ff", 3), "zh": ("\u4e00-\u9fff", 2), "ru": ("\u0400-\u04ff", 1)}
_OTHERS = "".join(r for r, _ in _SCRIPTS.values())
_OTHER, _THAI = re.compile(f"[{_OTHERS}]"), re.compile("[\u0e00-\u0e7f]")
_RUNS = {k: (re.compile(f"[{r}]+"), w) for k, (r, w) in _SCRIPTS.items()}
_LATIN = re.compile(f"[^\\W\\d_{_OTHERS}]+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: A word tells a language if it is at least this part of its label's short words.
TELLING = 0.001
UNSEEN = -11.5


def script_of(text: str) -> str:
    """The script with most letters in the whole text; latin if it has none of the others."""
    if not _OTHER.search(text):
        return "latin"
    c = {k: w * sum(map(len, r.findall(text))) for k, (r, w) in _RUNS.items()}
    c["latin"] = sum(map(len, _LATIN.findall(text)))
    if c["ja"] and c["ja"] * 4 >= c["zh"]:
        c["ja"] += c.pop("zh")
    return max(c, key=lambda k: (c[k], k))


class Languages:
    """Tells the languages of the Latin script apart by the words their labels use: {label: {word: log share}}."""

    def __init__(self, rows: dict[str, dict[str, float]]):
        self.rows = rows
        self.by_word: dict[str, list[tuple[str, float]]] = {}
        for label, ws in rows.items():
            for w, v in ws.items():
                # What a word adds to a label over the share of an unseen word.
                self.by_word.setdefault(w, []).append((label, v - UNSEEN))

    def of(self, text: str, label: str | None) -> str:
        s = script_of(text)
        if s != "latin":
            return s
        own = (label or "")[:2].lower()
        votes: dict[str, float] = {}
        for w in _WORDS.findall(text.lower().replace("’", "'")):
            if w in self.by_word:
                for lang, v in self.by_word[w]:
                    votes[lang] = votes.get(lang, 0.0) + v
        if votes:
            return max(votes, key=lambda k: (votes[k], k == own, k))
        return own if own in self.rows else "en"


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w, value): the short words (up to six letters) of each label with at least TELLING of its short words,
    and the log of their share; at most 1 / TELLING words a label. Labels whose texts are mostly in another
    script are left out. Counts cover all documents."""
    label = F.regexp_extract(F.lower(lang), "^([a-z]{2})(?:$|[^a-z])", 1)
    src = docs.where(F.col(text).isNotNull()).select(label.alias("lang"), F.col(text).alias("t")).where("lang <> ''")
    latin = src.groupBy("lang").agg(F.avg(F.col("t").rlike(f"[{_OTHERS}]{{1}}").cast("int")).alias("o")).where("o < 0.5").select("lang")
    words = F.filter(F.regexp_extract_all(F.lower(F.translate("t", "’", "'")), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)), lambda w: F.length(w) <= 6)
    cnt = src.select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    cnt = shared_checkpoint(cnt.join(broadcast_if_small(latin, 10_000), "lang", "left_semi"))
    tot = cnt.groupBy("lang").agg(F.sum("n").alias("t"))
    return cnt.join(broadcast_if_small(tot, 10_000), "lang").where(F.col("n") >= TELLING * F.col("t")).select("lang", "w", F.log(F.col("n") / F.col("t")).alias("value"))


def _languages(rows: list) -> Languages:
    by: dict[str, dict[str, float]] = {}
    for r in rows:
        by.setdefault(r["lang"], {})[r["w"]] = r["value"]
    return Languages(by)


def blocks_of(text: str) -> list[list[tuple[int, int, str]]]:
    """Paragraphs as lists of (start, end, kind); kind is 'bullet', 'heading' or 'text'. A line that goes
    on in the next one (wrapped text) is joined with it."""
    rows: list[tuple[int, str]] = []
    at = 0
    for part in re.split("(\r\n|\n|\r|\x85|\u2028)", text):
        if part in ("\r\n", "\n", "\r", "\x85", "\u2028"):
            rows.append((-1, part))
        elif part:
            rows.append((at, part))
        at += len(part)
    lines: list[tuple[int, str, bool]] = []  # start, text, blank line before
    breaks = 2
    for st, t in rows:
        if st < 0:
            breaks += 1
        elif t.strip():
            lines.append((st, t, breaks > 1))
            breaks = 0
    out: list[list[tuple[int, int, str]]] = []
    ended = True
    for k, (st, t, blank) in enumerate(lines):
        lead = len(t) - len(t.lstrip())
        body = t.strip()
        a, b = st + lead, st + lead + len(body)
        nxt = lines[k + 1] if k + 1 < len(lines) else None
        after = nxt[1].strip()[:1] if nxt and not nxt[2] else ""
        last = body.rstrip("\"”»)）」』’'")[-1:]
        done = last in ENDERS or last in ":"
        fresh = blank or ended or not out
        if fresh and body[0] in BULLETS and re.match(rf"[{re.escape(BULLETS)}]\s+\S", body):
            off = len(body) - len(body[1:].lstrip())
            out.append([(a + off, b, "bullet")])
            ended = True
            continue
        head = fresh and not done and last not in ",;" and len(body) <= HEADING_CHARS and not after.islower()
        if head and script_of(body) == "th" and " " in body:
            head = False
        if head:
            out.append([(a, b, "heading")])
            ended = True
            continue
        if fresh and (blank or ended):
            out.append([(a, b, "text")])
        else:
            out[-1].append((a, b, "text"))
        ended = done or (script_of(body) == "th" and not (after and after.islower()))
    return out


def kind_of(tok: str) -> str:
    t = tok.lower().replace("’", "'")
    if t.isdigit():
        return "#1" if len(t) <= 2 else "#4" if len(t) == 4 else "#n"
    return t


MEASURES = ("all", "start", "lower", "upper_mid", "stop", "line_end", "goes_on")


@lru_cache(maxsize=200_000)
def token_facts(tok: str) -> tuple[bool, bool, bool, str, bool, bool, bool, str]:
    """What a token tells by itself: whether it ends with one full stop, with a hard mark, with other signs after
    them; its kind ('' if no word); whether it is small, large, and goes on a sentence; its kind as a next word."""
    core = tok.rstrip(",;:")
    stop = core.endswith(".") and not core.endswith("..")
    hard = core[-1:] in HARD or core.endswith("…") or core.endswith("..")
    word = core.rstrip(ENDERS)
    t = kind_of(word)
    if not t or not (t[0].isalnum() or t[0] == "#"):
        t = ""
    return stop, hard, core != tok, t, word[:1].islower(), word[:1].isupper(), tok[0].islower() or tok[0].isdigit() or tok[0] in ",;:-–—", kind_of(tok.rstrip(",;:" + ENDERS))


class Counts:
    """Corpus counts of one batch: per language and word a row of MEASURES, word pairs, and Thai chunks."""

    def __init__(self) -> None:
        self.words: dict[str, dict[str, list[int]]] = {}
        self.other: Counter = Counter()

    def rows(self) -> list[tuple[str, str, str, str, int]]:
        out = [(lang, m, w, "", n) for lang, ws in self.words.items() for w, row in ws.items() for m, n in zip(MEASURES, row) if n]
        return out + [(*k, n) for k, n in self.other.items()]


def observe(text: str, label: str | None, counts: Counts, langs: Languages) -> None:
    """Adds the corpus counts of one text."""
    for block in blocks_of(text):
        if block[0][2] != "text":
            continue
        a, b = block[0][0], block[-1][1]
        para = text[a:b]
        lang = langs.of(para, label)
        if lang == "th":
            for st, en, _ in block:
                for n, ch in enumerate(re.split(r"\s+", text[st:en])):
                    if ch and "฀" <= ch[0] < "຀":
                        counts.other[(lang, "open" if n == 0 else "chunk", ch[:5], "")] += 1
            continue
        words = counts.words.setdefault(lang, {})
        facts = [token_facts(t) for t in _TOKEN.findall(para)]
        last = len(facts) - 1
        fresh = True
        for k, (stop, hard, signs, t, small, large, _, _) in enumerate(facts):
            if not t:
                fresh = hard
                continue
            row = words.get(t)
            if row is None:
                row = words[t] = [0] * len(MEASURES)
            row[0] += 1
            if fresh:
                row[1] += 1
            if small:
                row[2] += 1
            elif large and not fresh:
                row[3] += 1
            if stop:
                row[4] += 1
                if k == last:
                    row[5] += 1
                elif signs:
                    row[6] += 1
                else:
                    nxt = facts[k + 1]
                    if nxt[6]:
                        row[6] += 1
                    if nxt[7]:
                        counts.other[(lang, "pair", t, nxt[7])] += 1
            fresh = stop or hard


def _llr(k1: str, n1: str, k2: str, n2: str) -> str:
    """Dunning's 2 log lambda for two binomials, as SQL over column names."""
    e = "1e-9"

    def ll(p: str, k: str, n: str) -> str:
        return f"({k}*ln(greatest({p},{e})) + ({n}-{k})*ln(greatest(1-({p}),{e})))"

    p, p1, p2 = f"(({k1}+{k2})/greatest({n1}+{n2},{e}))", f"({k1}/greatest({n1},{e}))", f"({k2}/greatest({n2},{e}))"
    return f"2*({ll(p1, k1, n1)}+{ll(p2, k2, n2)}-{ll(p, k1, n1)}-{ll(p, k2, n2)})"


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The model: rows (lang, what, word, next, value) of the languages' words, abbreviations, enders, starters,
    collocations and Thai openers. Counts cover every document; batches pre-aggregate before the shuffle."""
    told = shared_checkpoint(learn_languages(docs, text, lang))
    told_rows = bounded_rows(told, MOST_LANGUAGES, "telling words of all labels")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs = _languages(told_rows)
        for p in batches:
            c = Counts()
            for t, label in zip(p["t"], p["l"]):
                if isinstance(t, str) and t.strip():
                    observe(t, label if isinstance(label, str) else None, c, langs)
            yield pd.DataFrame(c.rows(), columns=["lang", "m", "w", "x", "n"])

    raw = spread(docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null")).mapInPandas(run, "lang string, m string, w string, x string, n bigint")
    cnt = raw.groupBy("lang", "m", "w", "x").agg(F.sum("n").alias("n"))
    cnt = shared_checkpoint(cnt)
    measures = ["all", "stop", "line_end", "goes_on", "start", "lower", "upper_mid", "open", "chunk"]
    word = cnt.where("m <> 'pair'").groupBy("lang", "w").pivot("m", measures).agg(F.sum("n")).na.fill(0)
    tot = word.groupBy("lang").agg(*[F.sum(m).cast("double").alias(f"t_{m}") for m in measures])
    word = shared_checkpoint(word.join(broadcast_if_small(tot, MOST_LANGUAGES), "lang"))
    # Abbreviations: full stops stick to the word (against a share of 0.99), the word is short, and it goes on.
    word = word.withColumn("len", F.length(F.regexp_replace("w", "[.]", ""))).withColumn("dots", F.regexp_count("w", F.lit("[.]")) + 1)
    p0, alone = "(t_stop/greatest(t_all,1))", "(all-stop)"
    null_l = f"(stop*ln(greatest({p0},1e-9)) + {alone}*ln(greatest(1-{p0},1e-9)))"
    alt_l = f"(stop*ln(0.99) + {alone}*ln(0.01))"
    word = word.withColumn("punkt", F.expr(f"-2*({null_l}-{alt_l}) * exp(-len) * dots * pow(greatest(len,1), -least({alone}, 50))"))
    word = word.withColumn("end_llr", F.expr(_llr("line_end", "stop", "(t_line_end-line_end)", "(t_stop-stop)")))
    word = word.withColumn("end_share", F.expr("line_end/greatest(stop,1)")).withColumn("end_base", F.expr("t_line_end/greatest(t_stop,1)")).withColumn("on_share", F.expr("goes_on/greatest(stop-line_end,1)"))
    abbr = word.where("stop >= 2 and w not like '#%' and (punkt >= 0.3 or (stop >= 10 and stop > 0.9*all and len <= 8)) and (on_share >= 0.3 or (end_share < 0.5*end_base and end_llr > 7.88) or (lang in ('hi', 'ar') and line_end = 0 and len <= 5))")
    abbr = abbr.withColumn("what", F.lit("abbr")).withColumn("value", F.when(F.col("end_share") >= 0.25 * F.col("end_base"), 1.0).otherwise(0.0))
    # A word after an abbreviation does not start a sentence.
    short = abbr.select("lang", "w").unionByName(word.where("length(w) = 1 and w not like '#%'").select("lang", "w")).distinct()
    after = cnt.where("m = 'pair'").join(short, ["lang", "w"], "left_semi").groupBy("lang", F.col("x").alias("w")).agg(F.sum("n").alias("after"))
    word = word.join(after, ["lang", "w"], "left").withColumn("start", F.greatest(F.col("start") - F.coalesce("after", F.lit(0)), F.lit(0))).drop("t_start")
    word = shared_checkpoint(word)
    word = word.join(broadcast_if_small(word.groupBy("lang").agg(F.sum("start").cast("double").alias("t_start")), MOST_LANGUAGES), "lang")
    starters = word.where(f"start >= 3 and w not like '#%' and start/all > t_start/greatest(t_all,1) and ({_llr('start', 'all', '(t_start-start)', '(t_all-all)')}) > 30").withColumn("what", F.lit("start")).withColumn("value", F.lit(1.0))
    lowered = word.where("lower >= 2 and lower > upper_mid").withColumn("what", F.lit("lower")).withColumn("value", F.lit(1.0)).where("start > 0")
    opens = word.where("open >= 1 and open >= 0.01*(open+chunk)").withColumn("what", F.lit("open")).withColumn("value", F.lit(1.0))
    singles = [x.select("lang", "what", "w", F.lit("").alias("x"), "value") for x in (abbr, starters, lowered, opens)]
    pair = cnt.where("m = 'pair' and w like '#%' and x not like '#%'").select("lang", "w", "x", F.col("n").alias("n12"))
    left = word.select("lang", "w", F.col("stop").cast("double").alias("n1"))
    right = word.select("lang", F.col("w").alias("x"), F.col("all").cast("double").alias("n2"), F.col("t_all").alias("nn"), "start")
    coll = pair.join(left, ["lang", "w"]).join(right, ["lang", "x"]).where(f"n12 >= 3 and n12/n1 > n2/nn and ({_llr('n12', 'n1', '(greatest(n2-n12,0))', '(nn-n1)')}) > 7.88 and n12 >= 0.5*n2")
    singles.append(coll.select("lang", F.lit("coll").alias("what"), "w", "x", F.lit(1.0).alias("value")))
    # A word before numbers ("No. 5") though it has uses without a full stop.
    numbered = cnt.where("m = 'pair' and w not like '#%' and x like '#%'").groupBy("lang", "w").agg(F.sum("n").alias("n12")).join(left, ["lang", "w"]).where("n12 >= 3 and n12 >= 0.5*n1")
    singles.append(numbered.select("lang", F.lit("coll").alias("what"), "w", F.lit("#").alias("x"), F.lit(1.0).alias("value")))
    out = told.select("lang", F.lit("lang").alias("what"), "w", F.lit("").alias("x"), "value")
    for s in singles:
        out = out.unionByName(s)
    return out


class Splitter:
    """Classifies the marks of a text by a learned model."""

    def __init__(self, rows: list[tuple[str, str, str, str, float]], langs: Languages | None = None):
        self.abbr: dict[tuple[str, str], bool] = {}
        self.latin: dict[str, bool] = {}
        self.sets: dict[str, set] = {"start": set(), "lower": set(), "coll": set(), "open": set()}
        told: dict[str, dict[str, float]] = {}
        for lang, what, w, x, v in rows:
            if what == "lang":
                told.setdefault(lang, {})[w] = v
            elif what == "abbr":
                self.abbr[(lang, w)] = v > 0
                if len(w) <= 6:
                    self.latin[w] = self.latin.get(w, False) or v > 0
            elif what == "coll":
                self.sets["coll"].add((w, x))
            else:
                self.sets[what].add((lang, w))
        self.langs = langs or Languages(told)

    def units(self, text: str, label: str | None = None) -> list[tuple[int, int]]:
        """(start, end) of the units in order; together they hold every character but blanks and bullets."""
        out: list[tuple[int, int]] = []
        for block in blocks_of(text):
            a, b = block[0][0], block[-1][1]
            if block[0][2] != "text":
                out.append((a, b))
                continue
            para = text[a:b]
            lang = self.langs.of(para, label)
            cuts = [c for c in self.cuts(para, lang, block, a)]
            starts = [0, *cuts]
            for k, s in enumerate(starts):
                e = starts[k + 1] if k + 1 < len(starts) else len(para)
                piece = para[s:e]
                s += len(piece) - len(piece.lstrip())
                if para[s:e].strip():
                    out.append((a + s, a + s + len(para[s:e].rstrip())))
        return out

    def cuts(self, para: str, lang: str, block: list[tuple[int, int, str]], off: int) -> list[int]:
        """Offsets in the paragraph where a next unit starts."""
        out: list[int] = []
        begin = 0
        spans = self.enclosed(para)
        k = 0
        n = len(para)
        thai = _THAI.search(para) is not None
        marks = [m.start() for m in _STOPS.finditer(para)]
        if thai:
            marks = sorted({*marks, *(m.start() for m in re.finditer(r"\s+", para))})
        for at in marks:
            if at < k:
                continue
            if para[at].isspace():
                e = at + len(para[at:]) - len(para[at:].lstrip())
                if at > begin and e < n and not self.inside(spans, at, begin) and self.thai_break(para, at, e):
                    out.append(e)
                    begin = e
                continue
            e = at
            while e < n and para[e] in ENDERS:
                e += 1
            k = e
            span = self.inside(spans, at, begin)
            whole = None
            if span is not None:
                if para[span[1] - 1] and para[e : span[1]].strip() and para[e : span[1]].strip("   ") != para[span[1] - 1]:
                    continue  # the mark is within quoted or bracketed words
                whole = span
                e = span[1]
                k = e
                while e < n and para[e] in ENDERS and para[e] not in "…":
                    e += 1
                k = e
            while e < n and para[e] in CLOSE and whole is None:
                e += 1
            j = e
            while j < n and para[j].isspace():
                j += 1
            if j >= n:
                break
            if self.is_cut(para, lang, begin, at, e, j, whole):
                out.append(j)
                begin = j
        return out

    @staticmethod
    def enclosed(para: str) -> list[tuple[int, int]]:
        """Outermost (start, end) of balanced quotes and brackets."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[str, int]] = []
        for m in _PAIRED.finditer(para):
            ch, at = m.group(), m.start()
            if stack and ch == stack[-1][0]:
                _, st = stack.pop()
                if not stack:
                    out.append((st, at + 1))
            elif ch == '"':
                if '"' in [c for c, _ in stack]:
                    while stack[-1][0] != '"':
                        stack.pop()
                    _, st = stack.pop()
                    if not stack:
                        out.append((st, at + 1))
                elif at == 0 or para[at - 1].isspace() or para[at - 1] in "([—–-.!?":
                    stack.append(('"', at))
            elif ch in OPEN:
                stack.append((OPEN[ch], at))
            elif any(ch == c for c, _ in stack):
                while stack[-1][0] != ch:
                    stack.pop()
                _, st = stack.pop()
                if not stack:
                    out.append((st, at + 1))
        return sorted(out)

    @staticmethod
    def inside(spans: list[tuple[int, int]], at: int, begin: int) -> tuple[int, int] | None:
        for s in spans:
            if s[0] < at < s[1]:
                return s
            if s[0] > at:
                break
        return None

    def thai_break(self, para: str, at: int, e: int) -> bool:
        before, after = para[at - 1], para[e]
        if "\n" in para[at:e] or "\r" in para[at:e]:
            return ("th", re.split(r"\s", para[e:], maxsplit=1)[0][:5]) in self.sets["open"]
        if before.isdigit() or (before.isalpha() and before.isascii()) or before in ".,":
            return False
        if not "฀" <= after < "຀":
            return False
        return ("th", re.split(r"\s", para[e:], maxsplit=1)[0][:5]) in self.sets["open"]

    def is_cut(self, para: str, lang: str, begin: int, at: int, e: int, j: int, whole: tuple[int, int] | None) -> bool:
        nxt = para[j]
        small = nxt.islower() and not para[j + 1 : j + 2].isupper()  # "iName" counts as a capital
        plain = nxt.isalpha() and nxt.lower() == nxt.upper()
        glued = j == e
        mark = para[at]
        if nxt in ",;:)]}»”’、，；：）」』%—–-/" or (nxt in "-–—" and not glued):
            return False
        cjk = "぀" <= nxt < "ꀀ" or nxt in "「『（“"
        if whole is not None:
            opened = whole[0] == begin or not para[begin : whole[0]].strip()
            if para[whole[0]] in "(（[":
                outer = opened or mark not in ENDERS
                return opened and not small and not (cjk and glued and not opened) if outer else False
            ended_outside = e > whole[1]
            if opened and not ended_outside and (cjk or "぀" <= para[whole[1] - 2] < "ꀀ" or para[at] in "。！？｡"):
                return False  # quoted words first, then who said them
            if opened and not ended_outside and glued:
                return False
            return not small
        if mark in "。｡．।|":
            return True
        if mark in "！？؟":
            return not small
        if mark in "!?":
            if small:
                return False
            return not glued or nxt.isupper() or cjk or plain or nxt in "\"“„«(¿¡"
        if para[at:e].startswith("…") or para[at : at + 2] == "..":
            return not small
        # one full stop
        k = at
        while k > begin and para[k - 1] not in _APART and not para[k - 1].isspace():
            k -= 1
        word = para[k:at]
        if glued:
            if not word or not (nxt.isupper() or nxt in "\"“„«(¿¡" or plain):
                return False
            if nxt.isupper() and not (para[j + 1 : j + 2].islower() or para[j + 1 : j + 2] in (" ", "'", ".")):
                return False
            if word[-1].isdigit() or word[-1] in "%€$":
                return True
            tail = re.split(r"[.\-'’]", word)[-1]
            return (len(tail) >= 3 or (len(tail) == 2 and tail.islower() and (lang, tail) not in self.abbr and tail not in self.latin)) and (tail.islower() or not tail.isascii() or tail.isupper() or tail.istitle()) and "/" not in word and "@" not in word and not re.search(r"[a-z]\.[a-z]", word)
        t = kind_of(word)
        nw = _NEXT_WORD.match(para, j)
        w = kind_of(nw.group().rstrip(",;:" + ENDERS)) if nw else ""
        if not word:
            return not small
        if small:
            return False
        if word[-1] in "%€$£¥₹":
            return True
        initial = len(word.strip("'’-–")) == 1 and word.strip("'’-–").isalpha()
        if t[0] == "#" or word[-1].isdigit():
            if (t, w) in self.sets["coll"]:
                return False
            return not nxt.isdigit() or len(word) > 2
        if lang in ("zh", "ja", "th") and (ord(nxt) >= 0x0E00 or word[-1:] > "\u02ff") and nxt not in "“„‘":
            return False  # these scripts end sentences with marks of their own
        if nxt.isdigit() and (t, "#") in self.sets["coll"]:
            return False
        known = self.abbr.get((lang, t))
        if known is None and t[0].isalpha() and t in self.latin:
            known = self.latin[t]  # words of another language within a text
        if initial and known is None:
            known = False
        if known is None:
            return True
        if nxt.isdigit():
            return known
        if nxt in "\"“„«(¿¡「（":
            return known
        if not (nxt.isupper() or nxt.islower()):  # no case
            return known and (lang, w) in self.sets["start"]
        if initial and not known:
            return False
        if (lang, w) in self.sets["start"] and ((lang, w) in self.sets["lower"] or known):
            return True
        return bool(known)


def keys_of(text: str) -> set[str]:
    """Every word of a text under which the classification may look something up."""
    out: set[str] = set()
    for tok in _TOKEN.findall(text):
        core = tok.rstrip(",;:")
        out |= {kind_of(core.rstrip(ENDERS)), kind_of(tok.rstrip(",;:" + ENDERS))}
        for m in re.finditer(r"[.]", tok):
            out.add(kind_of(tok[: m.start()]))
        out |= set(re.split(r"[.\-'’]", tok))
    for ch in re.split(r"\s+", text) if _THAI.search(text) else ():
        out.add(ch[:5])
    out.discard("")
    return out


def split_sentences(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, unit_no (from 0, in order), start_char, end_char, sentence.

    A model of up to MOST_MODEL rows travels with every task. A larger one stays where it is: each distinct text
    gets the rows of its own words by a join, with the same result.
    """
    model = model.select("lang", "what", "w", "x", "value")
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, unit_no int, start_char int, end_char int, sentence string"
    src = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).alias("l")).where("d is not null and t is not null"))

    def rows_of(sp: Splitter, d: object, t: str, label: object) -> list[tuple]:
        return [(d, k, a, b, t[a:b]) for k, (a, b) in enumerate(sp.units(t, label if isinstance(label, str) else None))]

    columns = ["doc_id", "unit_no", "start_char", "end_char", "sentence"]
    if model.limit(MOST_MODEL + 1).count() <= MOST_MODEL:
        rows = [tuple(r) for r in bounded_rows(model, MOST_MODEL, "sentence model")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sp = Splitter(rows)
            for p in batches:
                yield pd.DataFrame([r for d, t, label in zip(p["d"], p["t"], p["l"]) for r in rows_of(sp, d, t, label)], columns=columns)

        return src.mapInPandas(run, schema)

    told = bounded_rows(model.where("what = 'lang'"), MOST_LANGUAGES, "telling words of all labels")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(h, w) for h, t in zip(p["h"], p["t"]) for w in sorted(keys_of(t))], columns=["h", "w"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs = _languages(told)
        for p in batches:
            out = []
            for d, t, label, own in zip(p["d"], p["t"], p["l"], p["m"]):
                sp = Splitter([tuple(r[k] for k in ("lang", "what", "w", "x", "value")) for r in (own if own is not None else [])], langs)
                out += rows_of(sp, d, t, label)
            yield pd.DataFrame(out, columns=columns)

    keyed = src.withColumn("h", F.xxhash64("t"))
    need = keyed.select("h", "t").dropDuplicates(["h"]).mapInPandas(words, "h bigint, w string")
    per = need.join(model.where("what <> 'lang'"), "w").groupBy("h").agg(F.collect_list(F.struct("lang", "what", "w", "x", "value")).alias("m"))
    return keyed.join(per, "h", "left").select("d", "t", "l", "m").mapInPandas(joined, schema)

"""Personal information in free text: emails, phones, identity numbers, street addresses, names.

A semi-Markov conditional random field. Candidate segments carry features of the whole span (its shape,
its words, what stands before and after); dynamic programming over bounded segments chooses boundaries and
types jointly. The weights are trained by ``pii_train`` and kept in ``pii_weights.json``.

Defined results: null and empty texts have no mentions and are returned as they are; a repeated row gives
the same mentions; an empty table gives no rows. Offsets count code points.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, spread

TYPES = ("email", "phone", "national_id", "street_address", "person_name")
LONGEST = {"email": 26, "phone": 16, "national_id": 16, "street_address": 22, "person_name": 10}

# Words that mark kinds of tokens.
GIVEN = set("""james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven andrew paul joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott frank gregory samuel benjamin patrick alexander frederick peter henry adam simon oliver
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen katherine alexandra victoria anna emma maria julia sophie claire alice
josé juan carlos luis javier miguel antonio lucía carmen elena marco giulia luca francesca hans klaus jürgen ursula heike stefan petra anneliese ingrid sven björn søren astrid pierre jean chloé françois hélène zoë piotr agnieszka katarzyna tadeusz jan eva zsuzsa istván
siobhan aoife liam niamh kofi kwame amina fatima omar hamza mehmet ayşe priyanka arjun ananya rahul kenji yuki haruka seoyeon minjun wei xiaoming olga ivan dmitri svetlana nkechi emeka""".split())
SURNAME_ENDS = ("wick", "mere", "bury", "quist", "ström", "strom", "enko", "dze", "ovic", "sky", "ski", "moto", "elli", "ini", "eau", "son", "sen", "ley", "ton", "ford", "man", "mann", "berg", "stein", "ez", "escu", "oğlu", "nen", "wala", "ham", "well", "worth")
TITLES = set("mr mrs ms miss dr prof professor sir dame herr frau monsieur madame mme mlle señor señora sr sra m".split())
NAME_CUES = set("signed witness attention attn contact contacto name by von mit ist es avec con for to with from was not und and since regards dear caller tenant patient teacher author sender".split())
ORG_NEXT = set("act holdings ltd limited plc inc llc gmbh corp group company co sons bros brothers partners law treaty harbour mill bridge".split())
PARTICLES = set("van der den de la le von zu bin al el da dos di del ter".split())
STREETS = set("street st road rd lane ln avenue ave drive dr walk close court ct row way place pl square sq terrace boulevard blvd crescent gardens hill mews parade quay strasse straße str platz weg allee rue via viale piazza calle plaza avenida camino impasse chemin".split())
STREET_FIRST = set("via viale piazza rue calle plaza avenida am an im zum auf unter chemin impasse".split())
UNITS = set("flat apt apartment unit suite house block floor room".split())
ID_CUES = set("id ssn passport tax number nino nif nie dni employee identity national insurance cpr aadhaar pps insee tin".split())
PHONE_CUES = set("tel telephone phone fax mobile mob cell call reached ring dial tél telefon handy".split())
NUMBER_CUES = set("account invoice no ref reg registration version room clause model range sec note contract p page order".split())

LABELS = frozenset((ID_CUES | PHONE_CUES | {"address", "name", "contact", "room", "report", "notes"}) - {"ring"})

_TOK = re.compile(r"[^\W\d_]+(?:['’](?![sS]\b)[^\W\d_]+)*|\d+|[^\w\s]|_")
_AT = re.compile(r"\s*(?:[@＠]|[\(\[{]\s*at\s*[\)\]}])\s*", re.I)
_DOMAIN = re.compile(r"[\w-]+(?:\s*(?:\.|[\(\[{]\s*dot\s*[\)\]}]|\bdot\b)\s*[\w-]+)+", re.I)
_LABEL = re.compile(r"[\w-]+(?=\W|$)")
_EMAIL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*\s*(?:[@＠]|[\(\[{]\s*at\s*[\)\]}])\s*[\w-]+(?:\s*(?:\.|[\(\[{]\s*dot\s*[\)\]}]|\bdot\b)\s*[\w-]+)+", re.I)
_PHONE = re.compile(r"(?:\+|00)?\(?\d[\d\s().\-/]*\d(?:\s*(?:ext|x|extn|Durchwahl)\.?\s*\d{1,5})?", re.I)
_POSTCODES = re.compile(r"[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}|[A-Z]{2}\s*\d{5}(?:-\d{4})?|\b\d{5}(?:-\d{4})?\b")
_ADDR_FORMS = {
    "uk": re.compile(r"(?:(?:flat|unit|apt|apartment|suite)\s*\d+\w?\s*,\s*)?\d+\w?\s+(?:[NSEW]\.?\s+|st\.?\s+)?[\w'’.]+(?:\s+[\w'’.]+){0,3}\s*[,\n]\s*[\w ]+?\s+[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}", re.I),
    "us": re.compile(r"\d+\w?\s+(?:[NSEW]\.?\s+|st\.?\s+)?[\w'’.]+(?:\s+[\w'’.]+){0,3}(?:\s*,\s*(?:apt|unit|suite|flat)\.?\s*\d+\w?)?\s*[,\n]\s*[\w ]+?,?\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?", re.I),
    "de": re.compile(r"(?:am|an der|an|im|zum|auf dem|unter den)?\s*[^\W\d][\w'’-]*(?:[ -][^\W\d][\w'’-]*){0,3}\.?\s+\d+\w?\s*[,\n]\s*\d{5}\s+[^\W\d][\w'’-]*(?:\s+[^\W\d][\w'’-]*){0,2}", re.I),
    "it": re.compile(r"\d+(?:\s*(?:bis|ter|[a-d]))?\s*,?\s+(?:via|viale|piazza|rue|avenue|calle|chemin)\s+[^\W\d][\w'’-]*(?:\s+[^\W\d][\w'’-]*){0,4}\s*[,\n]\s*\d{5}\s+[^\W\d][\w'’-]*(?:\s+[^\W\d][\w'’-]*){0,2}", re.I),
}


class Doc:
    """Tokens of a text with the classes the features use."""

    def __init__(self, text: str, known: frozenset[str] | set[str], memo: dict[str, str] | None = None):
        self.text = text
        found = [(m.group(), m.start(), m.end()) for m in _TOK.finditer(text)]
        self.t, self.s, self.e = ([f[j] for f in found] for j in range(3))
        self.n = len(found)
        self.low = [x.lower() for x in self.t]
        self.sp = [True] * self.n
        self.nl = [False] * self.n
        lines = "\n" in text
        for k in range(1, self.n):
            gap = self.s[k] - self.e[k - 1]
            if not gap:
                self.sp[k] = False
            elif lines:
                self.nl[k] = "\n" in text[self.e[k - 1] : self.s[k]]
        # A word in small letters has the same kind wherever it stands.
        memo = {} if memo is None else memo
        self.k = []
        for k, x in enumerate(self.t):
            c = memo.get(x)
            if c is None:
                c = self.kind(k, known)
                if x.islower() and len(memo) < 500_000:
                    memo[x] = c
            self.k.append(c)

    def kind(self, k: int, known) -> str:
        """One letter: G given name, S surname-like, U unknown word, I initial, K known capital, l/u known or
        unknown small word, P particle, d digits, else the sign itself."""
        x, w = self.t[k], self.low[k]
        if x.isdigit():
            return "d"
        if not x[0].isalpha():
            return x
        if w in GIVEN:
            return "G" if x[0].isupper() else "g"
        if w in PARTICLES and (x[0].islower() or (len(x) > 1 and x.isupper() and k > 0 and self.t[k - 1].isupper())):
            return "P"
        if len(x) == 1 and x.isupper() and k + 1 < self.n and self.t[k + 1] == "." and self.e[k] == self.s[k + 1]:
            return "I"
        fam = len(w) >= 6 and w.endswith(SURNAME_ENDS) and w not in known
        if x[0].isupper():
            return "S" if fam else "K" if w in known or w in STREETS or w in ORG_NEXT else "U"
        return "s" if fam else "l" if w in known else "u"


def segments(d: Doc) -> list[tuple[int, int, str]]:
    """Candidate segments (start, end, type): every bounded span whose ends and inside can be of the type."""
    out: list[tuple[int, int, str]] = []
    n, t, k = d.n, d.t, d.k
    at: dict[int, int] = {}
    end: dict[int, int] = {}
    for m in _AT.finditer(d.text):
        if not at:
            at, end = {s: i for i, s in enumerate(d.s)}, {e: i + 1 for i, e in enumerate(d.e)}
        # Both sides run to the end of their characters, however long.
        a0 = m.start()
        while a0 and (d.text[a0 - 1].isalnum() or d.text[a0 - 1] in "_.+-"):
            a0 -= 1
        rm = _DOMAIN.match(d.text, m.end())
        if a0 == m.start() or not rm:
            continue
        starts = [p for p in range(a0, m.start()) if p in at and (p == a0 or d.text[p - 1] in ".+-")]
        ends = [x.end() for x in _LABEL.finditer(d.text, m.end(), rm.end())]
        # The whole address, and its cuts where the span may be shorter; the longest is always among them.
        for a in starts[:LONGEST["email"]]:
            for b in [*ends[: LONGEST["email"]], *ends[-1:]]:
                if b in end and end[b] > at[a]:
                    out.append((at[a], end[b], "email"))
    # Tokens that postcodes have: an address needs one after its first token.
    codes = [j for j in range(1, n) if k[j] == "d" and (len(t[j]) == 5 or (not d.sp[j] and len(t[j - 1]) <= 2 and t[j - 1].isalpha()))]
    ahead = 0
    for i in range(n):
        x = t[i]
        while ahead < len(codes) and codes[ahead] <= i:
            ahead += 1
        # No span starts at a known small word that names no unit, nor at a sign but + and (.
        if (k[i] == "l" and d.low[i] not in UNITS) or (not x.isalnum() and x not in "+(" and not x[0].isalpha()):
            continue
        if k[i] == "d" or x in "+(":
            if not (x in "+(" and i + 1 < n and k[i + 1] != "d") and not (i and not d.sp[i] and k[i - 1] in "GSUKIlu"):
                digits = 0
                for j in range(i, min(n, i + LONGEST["phone"])):
                    y = t[j]
                    if k[j] == "d":
                        digits += len(y)
                    elif y not in "+()-./" and d.low[j] not in ("ext", "x", "extn"):
                        break
                    if (d.nl[j] and j > i) or (y == "." and j + 1 < n and d.sp[j + 1] and d.low[j - 1] not in ("ext", "x", "extn")):
                        break
                    if digits > 18:
                        break
                    if k[j] == "d" and 7 <= digits and one_dot(t, d.low, i, j):
                        out.append((i, j + 1, "phone"))
        if k[i] == "d" or (x.isupper() and len(x) <= 2 and x.isalpha()):
            chars = digits = 0
            for j in range(i, min(n, i + LONGEST["national_id"])):
                y = t[j]
                if d.nl[j] and j > i:
                    break
                if k[j] == "d":
                    chars += len(y)
                    digits += len(y)
                elif y.isalpha() and y.isupper() and len(y) <= 2:
                    chars += len(y)
                elif y not in "-/.":
                    break
                if chars > 18:
                    break
                if y.isalnum() and 7 <= chars and digits >= 5 and one_dot(t, d.low, i, j):
                    out.append((i, j + 1, "national_id"))
        if ahead < len(codes) and codes[ahead] < i + LONGEST["street_address"] and (k[i] == "d" or d.low[i] in UNITS or (x[0].isupper() and x.isalpha() and (d.low[i] in STREET_FIRST or (i + 5 < n and any(k[q] == "d" for q in range(i + 1, i + 4)))))):
            words = digit = lines = run_small = 0
            code = False  # whether a token that postcodes have was met
            for j in range(i, min(n, i + LONGEST["street_address"])):
                y = t[j]
                code = code or j == codes[ahead]
                if d.nl[j] and j > i:
                    lines += 1
                if lines > 1 or (not y.isalnum() and y not in ",.-'’" and not y.replace("'", "").replace("’", "").isalpha()):
                    break
                if y == "." and len(t[j - 1]) > 4 and not d.low[j - 1].endswith("str"):
                    break
                small = y.isalpha() and y.islower() and not d.low[j] in STREET_FIRST | UNITS | STREETS | {"bis", "ter"} and not (y == "s" and t[j - 1] in "'’")
                run_small = run_small + 1 if small else 0
                if run_small > 2 or (small and len(y) > 7):
                    break
                words += y[0].isalpha()
                digit += k[j] == "d"
                if code and j - i >= 4 and words >= 2 and digit >= 2 and y.isalnum() and not (j + 1 < n and not d.sp[j + 1] and t[j + 1].isalnum()):
                    out.append((i, j + 1, "street_address"))
        titled = bool(i) and (d.low[i - 1] in TITLES and t[i - 1][0].isupper() or t[i - 1] == "." and i > 1 and d.low[i - 2] in TITLES and t[i - 2][0].isupper())
        if k[i] in "GSUIgsu" or (k[i] == "P" and i + 1 < n) or (k[i] == "K" and (titled or i + 2 < n and t[i + 1] == "," and k[i + 2] in "GI")):
            joined = k[i] != "P" or t[i + 1] == "-"  # a particle leads a name only before a hyphen or a comma
            full = bool(i) and (t[i - 1][0].isupper() and d.low[i - 1] in TITLES or t[i - 1] == "." and i > 1 and t[i - 2][0].isupper() and d.low[i - 2] in TITLES)
            words_in = 0  # two unknown words written large may be a name no list helps with
            for j in range(i, min(n, i + LONGEST["person_name"])):
                c = k[j]
                # A known word written large can be a surname beside a given name, an initial or a title.
                if c == "K" and (j > i and (k[j - 1] in "GI" or k[j - 1] == "." and k[j - 2] == "I" or k[j - 1] in "-,") or j + 1 < n and (t[j + 1] == "," and j + 2 < n and k[j + 2] in "GI") or titled):
                    c = "U"
                if j > i and d.nl[j] and d.text[d.e[j - 1] : d.s[j]].count("\n") > 1:
                    break
                if c in "GSUIgsuP":
                    full = full or c in "GSgsI"
                elif c == "." and k[j - 1] == "I" or c == "-" or c in "'’":
                    pass
                elif c == "," and j > i and "," not in t[i:j]:
                    pass
                else:
                    break
                words_in += c == "U"
                if c in "GSUgsu" and (full or words_in > 1) and (joined or "," in t[i:j]):
                    out.append((i, j + 1, "person_name"))
    return out


def one_dot(t: list[str], low: list[str], i: int, j: int) -> bool:
    """False for a span with a single full stop, as in a decimal, that no 'ext.' explains."""
    return sum(t[x] == "." and low[x - 1] not in ("ext", "x", "extn") for x in range(i, j + 1)) != 1


def features(d: Doc, a: int, b: int, typ: str) -> list[str]:
    """Features of a whole span in its place."""
    f = [f"{typ}:bias"]
    t, k, low = d.t, d.k, d.low
    span = d.text[d.s[a] : d.e[b - 1]]
    p = low[a - 1] if a else "^"
    q = low[b] if b < d.n else "$"
    pk = k[a - 1] if a else "^"
    qk = k[b] if b < d.n else "$"
    near = range(max(0, a - 4), a)
    stops = [x for x in near if t[x] == "." and x and len(t[x - 1]) > 4]  # a sentence's end, no abbreviation
    before = {low[x] for x in near if low[x][0].isalpha() and (not stops or x > stops[-1])}
    glue_p, glue_q = a > 0 and not d.sp[a], b < d.n and not d.sp[b]
    if typ == "email":
        f.append("email:full" if _EMAIL.fullmatch(span) else "email:part")
        if glue_p and p in ".+-_" or pk in "GSUgsulud" and glue_p:
            f.append("email:left_goes_on")
        if (q == "." and glue_q or q in ("dot", "[", "(") or (q == "-" and glue_q)) and b + 1 < d.n and (t[b + 1].isalnum()) and not (q == "." and d.sp[b + 1]):
            f.append("email:right_goes_on")
        tail = low[b - 1]
        f.append("email:tld" if 2 <= len(tail) <= 8 and tail.isalpha() else "email:no_tld")
    elif typ in ("phone", "national_id"):
        shape = re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(r"\s+", " ", span)))
        squeezed = re.sub(r"9+", "9", shape)
        f += [f"{typ}:shape={squeezed}", f"{typ}:n={sum(map(str.isdigit, span))}"]
        f.append(f"{typ}:lead={'+' if span[0] == '+' else '00' if span.startswith('00') else '0' if span[0] == '0' else '(' if span[0] == '(' else 'x'}")
        if before & PHONE_CUES:
            f.append(f"{typ}:phone_cue")
        if before & ID_CUES:
            f.append(f"{typ}:id_cue")
        if before & NUMBER_CUES and not before & (ID_CUES | PHONE_CUES):
            f.append(f"{typ}:number_cue")
        f.append(f"{typ}:len9={shape if len(shape) <= 20 else 'long'}")
        if pk == "d" or (glue_p and p in "+-/.(") or p == "+":
            f.append(f"{typ}:left_goes_on")
        if qk == "d" or (glue_q and q in "-/" and b + 1 < d.n and k[b + 1] == "d") or (q in ("ext", "x") and b + 1 < d.n) or (glue_q and q[0].isalpha()) or (len(q) <= 2 and t[b].isupper() and t[b].isalpha() if b < d.n else False):
            f.append(f"{typ}:right_goes_on")
        if p in ("$", "€", "£", "¥") or q in ("%", "million", "mn", "m") or (q == "." and glue_q and b + 1 < d.n and k[b + 1] == "d" and not d.sp[b + 1]):
            f.append(f"{typ}:amount")
        if p == "(" and q == ")":
            f.append(f"{typ}:in_brackets")
        if p == "|":
            f.append(f"{typ}:cell")
        if span.count("(") != span.count(")"):
            f.append(f"{typ}:odd_bracket")
        if q == "to" or q == "units" or p == "to":
            f.append(f"{typ}:range")
    elif typ == "street_address":
        forms = [x for x, r in _ADDR_FORMS.items() if r.fullmatch(span)]
        f += [f"street_address:form={x}" for x in forms] or ["street_address:form=none"]
        ws = set(low[a:b])
        if ws & STREETS:
            f.append("street_address:street")
        if ws & UNITS:
            f.append("street_address:unit")
        pcs = list(_POSTCODES.finditer(span if not span.isupper() else span))
        f.append("street_address:pc=none" if not pcs else "street_address:pc=end" if pcs[-1].end() == len(span) else "street_address:pc=inside")
        f.append(f"street_address:start={k[a] if k[a] in 'dK' else 'unit' if low[a] in UNITS else 'w'}")
        f.append(f"street_address:end={'d' if k[b - 1] == 'd' else 'A' if t[b - 1].isupper() and len(t[b - 1]) <= 3 else 'w'}")
        if pcs and pcs[-1].end() == len(span) and re.fullmatch(r"\d{5}", pcs[-1].group()) and qk in "SUKG":
            f.append("street_address:town_follows")
        if not glue_q and qk in "SUKG" and t[b - 1][0].isalpha() and not d.nl[b] and low[b] not in ORG_NEXT and t[b].isupper() == t[b - 1].isupper() and not (t[b - 1].isupper() and len(t[b - 1]) <= 3):
            f.append("street_address:right_goes_on")
        if q == "-" and glue_q and b + 1 < d.n and k[b + 1] == "d":
            f.append("street_address:right_goes_on")
        if pk == "d" or (p == "," and a > 1 and (k[a - 2] == "d" or low[a - 2] in UNITS)) or p in UNITS or (pk in "SUKG" and k[a] != "d" and not glue_p and low[a] not in STREET_FIRST):
            f.append("street_address:left_goes_on")
        if a > 2 and p == "," and k[a - 2] in "dUSK" and (low[a - 3] in UNITS or (k[a - 3] == "d" and a > 3 and low[a - 4] in UNITS)):
            f.append("street_address:unit_before")
        if ws & TITLES - STREETS:
            f.append("street_address:title")
    else:
        pat = "".join(k[a:b]).replace("I.", "I")
        f += [f"person_name:pat={pat.lower() if pat.islower() else pat}" if len(pat) <= 7 else "person_name:pat=long"]
        caps = [x for x in t[a:b] if x[0].isalpha() and x.lower() not in PARTICLES]
        f.append("person_name:case=" + ("lower" if all(x.islower() for x in caps) else "upper" if all(x.isupper() for x in caps) else "title" if all(x[0].isupper() for x in caps) else "mixed"))
        f.append(f"person_name:words={len(caps)}")
        if any(c in "Gg" for c in pat):
            f.append("person_name:given")
        if any(c in "Ss" for c in pat):
            f.append("person_name:surname")
        if any(c in "Uu" for c in pat):
            f.append("person_name:unknown")
        if not any(c in "GgSsI" for c in pat):
            cue = "cue" if before & NAME_CUES or p in ":|(;" else "none"
            f += ["person_name:unlisted", f"person_name:unlisted_before={'^' if p == '^' or d.nl[a] else cue}", f"person_name:unlisted_after={qk if qk in ',.;|(:' else 'l' if qk in 'lus' else 'o'}"]
        if "K" in pat:
            f.append("person_name:known")
            f += [f"person_name:known_listed={any(c in 'GI' for c in pat)}", f"person_name:known_place={low[b - 1] in STREETS or low[b - 1] in ORG_NEXT}", f"person_name:known_after={qk if qk in ',.;|(:-' else 'l' if qk in 'lus' else 'o'}", f"person_name:known_before={'^' if p == '^' or d.nl[a] else 'cue' if before & NAME_CUES or p in ':|(;,' else 'none'}"]
            f.append("person_name:known_" + ("last" if pat[-1] == "K" else "first" if pat[0] == "K" else "inside") + ("_street" if low[b - 1] in STREETS else ""))
        if "," in pat:
            f.append("person_name:comma_" + ("given" if pat.split(",")[1][:1] in "GgI" and "S" in pat.split(",")[0].upper() else "other"))
        if (a and t[a - 1][0].isupper() and p in TITLES) or (p == "." and a > 1 and t[a - 2][0].isupper() and low[a - 2] in TITLES):
            f.append("person_name:title_before")
        if before & NAME_CUES or p in ":|,":
            f.append("person_name:cue_before")
        if qk in "GSUI" and not glue_q and not d.nl[b] or (q == "-" and glue_q) or (qk in "gs" and pat.islower()):
            f.append("person_name:right_goes_on")
        if q == "," and b + 1 < d.n and k[b + 1] in "GIg" and "," not in pat and "G" not in pat.upper():
            f.append("person_name:given_follows")
        if (pk in "GSI" or (pk == "." and a > 1 and k[a - 2] == "I") or (pk == "-" and glue_p)) and (p not in TITLES):
            f.append("person_name:left_goes_on")
        if p == "," and a > 1 and k[a - 2] in "SU" and k[a] in "GI" and "," not in pat:
            f.append("person_name:surname_before")
        if q in ORG_NEXT or q == "&" or (q == "and" and b + 1 < d.n and low[b + 1] == "sons"):
            f.append("person_name:org_after")
        if p in ("@", "&") or q in ("@", "＠") or (q == "." and glue_q and b + 1 < d.n and not d.sp[b + 1]) or (q in "_+" and glue_q) or (glue_p and p in "._+-@/"):
            f.append("person_name:in_address")
        if set(low[a:b]) & LABELS:
            f.append("person_name:label")
        if any(k[x] == "I" and not d.sp[x] for x in range(a + 1, b)):
            f.append("person_name:glued_initials")
        if any(d.nl[x] for x in range(a + 1, b)):
            f.append("person_name:line_end_inside")
        if low[b - 1] in STREETS or q in STREETS:
            f.append("person_name:street")
    return f


class SemiCrf:
    """Scores, decoding and training over bounded segments; tokens outside entities score 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = dict(weights or {})

    def arcs(self, d: Doc) -> list[tuple[int, int, str, list[str]]]:
        return [(a, b, y, features(d, a, b, y)) for a, b, y in dict.fromkeys(segments(d))]

    def score(self, f: list[str]) -> float:
        return sum(self.w.get(x, 0.0) for x in f)

    def decode(self, d: Doc) -> list[tuple[int, int, str]]:
        """The best segmentation: (first token, end token, type) of its entities."""
        best = [0.0] * (d.n + 1)
        back: list[tuple[int, str] | None] = [None] * (d.n + 1)
        by: dict[int, list[tuple[int, str, float]]] = {}
        for a, b, y, f in self.arcs(d):
            s = self.score(f)
            if s > 0:
                by.setdefault(b, []).append((a, y, s))
        for j in range(1, d.n + 1):
            best[j], back[j] = best[j - 1], None
            for a, y, s in by.get(j, ()):
                if best[a] + s > best[j] + 1e-12:
                    best[j], back[j] = best[a] + s, (a, y)
        out, j = [], d.n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                a, y = back[j]
                out.append((a, j, y))
                j = a
        return out[::-1]

    def gradient(self, arcs: list[tuple[int, int, str, list[str]]], n: int, gold: set[tuple[int, int, str]]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of the gold segmentation and its gradient by forward-backward."""

        def plus(a: float, b: float) -> float:
            if a < b:
                a, b = b, a
            return a if b == -math.inf else a + math.log1p(math.exp(b - a))

        sc = [self.score(f) for *_, f in arcs]
        ends: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for x, (a, b, _, _) in enumerate(arcs):
            ends.setdefault(b, []).append(x)
            starts.setdefault(a, []).append(x)
        fwd = [0.0] * (n + 1)
        for j in range(1, n + 1):
            v = fwd[j - 1]
            for x in ends.get(j, ()):
                v = plus(v, fwd[arcs[x][0]] + sc[x])
            fwd[j] = v
        bwd = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            v = bwd[i + 1]
            for x in starts.get(i, ()):
                v = plus(v, bwd[arcs[x][1]] + sc[x])
            bwd[i] = v
        z = fwd[n]
        g: dict[str, float] = {}
        ll = -z
        for x, (a, b, y, f) in enumerate(arcs):
            is_gold = (a, b, y) in gold
            ll += sc[x] if is_gold else 0.0
            m = float(is_gold) - math.exp(min(0.0, fwd[a] + sc[x] + bwd[b] - z))
            if abs(m) > 1e-6:
                for name in f:
                    g[name] = g.get(name, 0.0) + m
        return ll, g


def trim(text: str, a: int, b: int, typ: str) -> tuple[int, int]:
    """A span without the signs that surround it."""
    while a < b and (text[a].isspace() or text[a] in ",;:.|\"'“”‘’<>[{"):
        a += 1
    if typ == "phone" and text[a] == "(" and text[a:b].count("(") > text[a:b].count(")"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:|\"“”‘’<>]}!?" or (text[b - 1] == ".")):
        b -= 1
    return a, b


class PiiFinder:
    def __init__(self, known: set[str] | frozenset[str], weights: dict[str, float] | None = None):
        self.known = known
        self.memo: dict[str, str] = {}
        self.crf = SemiCrf(weights if weights is not None else load_weights())

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of the mentions in order."""
        if not text or not re.search(r"\w", text):
            return []
        d = Doc(text, self.known, self.memo)
        out = []
        for a, b, y in self.crf.decode(d):
            s, e = trim(text, d.s[a], d.e[b - 1], y)
            if e > s:
                out.append((s, e, y))
        return out

    def redact(self, text: str) -> str:
        """The text with a typed placeholder for every mention."""
        out, at = [], 0
        for a, b, y in self.find(text):
            out += [text[at:a], f"[{y.upper()}]"]
            at = b
        return "".join(out) + text[at:]


def load_weights() -> dict[str, float]:
    return json.loads((Path(__file__).parent / "pii_weights.json").read_text(encoding="utf-8"))


MOST_KNOWN = 500_000
#: Sightings that a word's share of small writing is shrunk by.
SHRINK = 3
#: A word that is no part of an address on the net.
PLAIN_WORD = r"(?<![\p{L}\p{N}@＠._+\-])\p{L}+(?![\p{L}\p{N}@＠_+\-]|\.\p{L}|\s*(?:@|＠|\(at\)|\[at\]))"


def known_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(w) words that the corpus writes small at least as often as not, so a capital alone makes no name of them.
    The share is shrunk by SHRINK sightings, so that one or two say nothing; at any size it is a share."""
    w = texts.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PLAIN_WORD), F.lit(0))).alias("x"))
    c = w.groupBy(F.lower("x").alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("x") == F.lower("x")).cast("int")).alias("small"))
    return c.where(f"small >= 0.5 * (n + {SHRINK}) and length(w) >= 2").select("w")


def _with_known(texts: DataFrame, text: str) -> tuple[DataFrame, frozenset[str] | None]:
    """Up to MOST_KNOWN known words travel with the tasks. More stay where they are: each distinct text gets those
    of its own words by a join, as ``__known``, with the same result."""
    known = known_words(texts, text)
    if known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN:
        return spread(texts), frozenset(r["w"] for r in bounded_rows(known, MOST_KNOWN, "known words"))
    src = texts.withColumn("__h", F.xxhash64(text))
    own = src.select("__h", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).distinct()
    per = own.join(known, "w").groupBy("__h").agg(F.collect_list("w").alias("__known"))
    return src.join(per, "__h", "left").drop("__h"), None


def _finders(known: frozenset[str] | None, weights: dict[str, float] | None):
    """A function from a row's own known words to its finder."""
    crf = SemiCrf(weights if weights is not None else load_weights())
    shared = PiiFinder(known, crf.w) if known is not None else None
    return lambda own: shared if shared is not None else PiiFinder(frozenset(own if own is not None else ()), crf.w)


def find_pii(texts: DataFrame, ids: list[str], text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """Columns ``ids``, pii_type, start_char, end_char, mention; one row a mention, over whole texts."""
    src, known = _with_known(texts.select(*ids, F.col(text).alias("__text")).where("__text is not null"), "__text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*ids).schema) + ", pii_type string, start_char int, end_char int, mention string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finders(known, weights)
        for p in batches:
            own = p["__known"] if "__known" in p else [None] * len(p)
            out = [(*row, y, a, b, t[a:b]) for row, t, w in zip(p[ids].itertuples(index=False, name=None), p["__text"], own) for a, b, y in finder(w).find(t)]
            yield pd.DataFrame(out, columns=[*ids, "pii_type", "start_char", "end_char", "mention"])

    return src.mapInPandas(run, schema)


def redact_pii(texts: DataFrame, text: str = "text", into: str = "redacted", weights: dict[str, float] | None = None) -> DataFrame:
    """``texts`` with a column ``into``: the text with typed placeholders, else unchanged."""
    base = texts.drop(into)
    src, known = _with_known(base, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finders(known, weights)
        for p in batches:
            own = p["__known"] if "__known" in p else [None] * len(p)
            p[into] = [finder(w).redact(t) if isinstance(t, str) else None for t, w in zip(p[text], own)]
            yield p.drop(columns="__known", errors="ignore")

    return src.mapInPandas(run, base.schema.simpleString()[7:-1] + f",{into}:string")

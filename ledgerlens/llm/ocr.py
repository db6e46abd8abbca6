"""Repair of text from scanned pages.

A word that is not credible as printed is looked up completely: automata of its optical confusions (every
word that up to two explain, however many edits they need) and, where none explains it, of its Levenshtein
distance are intersected with a trie of the corpus vocabulary; all finds are ranked by frequency, by the costs of
confusions as the corpus has them, and by neighbours. Then page numbers and running headers are removed, words
split over line ends are joined and the lines reflowed into paragraphs.

Only wrapped text (lines that end where the next word did not fit, or that split a known word) is taken for a
scan; other texts,
tables included, are returned unchanged. Null and blank content gives no findings and is kept; repeated
chunks give repeated rows unless the caller drops them; an empty corpus repairs nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, shared_checkpoint, spread

# What optical readers confuse, (as read, as printed).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("+", "t"), ("|", "l"), ("!", "l"),
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("tl", "d"),
    ("ri", "n"), ("n", "ri"), ("nn", "m"), ("lc", "k"), ("f", "t"), ("t", "f"), ("h", "b"), ("b", "h"), ("o", "c"), ("a", "o"), ("o", "a"), ("l", "t"), ("t", "l"), ("j", "i"), ("q", "g"),
]
_BY_READ: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _BY_READ.setdefault(_a, []).append(_b)
_PLAIN = str.maketrans("0156+", "olsbt")
HYPHENS = "-‐¬­‑"
_EDGE = ".,;:!?()[]{}\"“”„«»'‘’…*•$€£¥₹%#~=<>"
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_WHOLE_WORD, _ANY_LETTER = re.compile(_WORD), re.compile(r"[^\W\d_]")
_NET = re.compile(r"[@/\\]|\.\w+\.|\w\.\w{3,}")
_CODE = re.compile(r"(?:FY|Q|H|v|V|No)?[\d.,:/-]+(?:[a-zA-Z%]{1,2})?|[A-Z]{1,3}\d+[A-Z]*|\d+[A-Za-z]{1,3}")
_SIGN_IN_WORD = re.compile(r"[A-Za-z]+[0156+][a-z]+|[A-Za-z][a-z]{2,}[0156+]")
_NUMERIC, _HAS_DIGIT = re.compile(r"((?:FY|Q|v)?)([\dlIOo|][\dlIOo|.,'’]*)((?:m|mn|bn|x|k|st|nd|rd|th)?)"), re.compile(r"\d")
_GAPS, _SPLIT = re.compile(r"\S\s{3,}\S"), re.compile(rf"[^\W\d_][{HYPHENS}]$")
_PAGE = re.compile(r"^\s*\W{0,3}(?:(?:page|pg\.?|p\.?|seite|página|pagina|s\.)\s*)?[\[(—–-]*\s*([0-9lIOo]{1,4})\s*(?:(?:of|/|von|de)\s*[0-9lIOo]{1,4})?\s*[\])—–|-]*\s*$", re.I)
MOST_WORDS, MOST_PAIRS, MOST_TEMPLATES = 600_000, 1_500_000, 50_000
LEAST_COUNT = 4
#: Cost of a listed confusion before the corpus tells how frequent each is, and of an edit that no list has.
CONFUSED, UNSEEN_EDIT = 3.0, 9.0


class Trie:
    """A vocabulary; a node is [children, count of the word that ends here, largest count below]."""

    def __init__(self, counts: dict[str, int]):
        self.root: list = [{}, 0, 0]
        for w, n in counts.items():
            node = self.root
            for ch in w:
                node[2] = max(node[2], n)
                node = node[0].setdefault(ch, [{}, 0, 0])
            node[1] = n
            node[2] = max(node[2], n)


class LevenshteinAutomaton:
    """All strings within ``most`` edits of a word, as a deterministic automaton built while it is used.

    A state is a row of distances capped at most + 1; letters that the word doesn't have share one
    transition. State -1 accepts nothing any more.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most, self.letters = word, most, set(word)
        first = tuple(min(i, most + 1) for i in range(len(word) + 1))
        self.ids, self.rows = {first: 0}, [first]
        self.to: list[dict[str, int]] = [{}]
        self.accepts = [first[-1] <= most]

    def step(self, state: int, ch: str) -> int:
        key = ch if ch in self.letters else ""
        got = self.to[state].get(key)
        if got is not None:
            return got
        cap, old = self.most + 1, self.rows[state]
        row = [min(old[0] + 1, cap)]
        for i, w in enumerate(self.word):
            row.append(min(cap, row[i] + 1, old[i + 1] + 1, old[i] + (w != key)))
        new = tuple(row)
        got = -1 if min(new) > self.most else self.ids.get(new)
        if got is None:
            got = self.ids[new] = len(self.rows)
            self.rows.append(new)
            self.to.append({})
            self.accepts.append(new[-1] <= self.most)
        self.to[state][key] = got
        return got

    def within(self, trie: Trie, least: float = 0) -> list[tuple[str, int, int]]:
        """Every (word, edits, count) of the trie that the automaton accepts, of words counted at least
        ``least`` times; branches without such words are not entered."""
        out: list[tuple[str, int, int]] = []
        stack = [("", trie.root, 0)]
        letters, to = self.letters, self.to
        while stack:
            pre, node, state = stack.pop()
            if self.accepts[state] and node[1] and node[1] >= least:
                out.append((pre, self.rows[state][-1], node[1]))
            have = to[state]
            for ch, nxt in node[0].items():
                if nxt[2] >= least:
                    t = have.get(ch if ch in letters else "")
                    if t is None:
                        t = self.step(state, ch)
                    if t >= 0:
                        stack.append((pre + ch, nxt, t))
        return out


def explained(read: str, printed: str, most: int = 2) -> int | None:
    """The fewest confusions that turn ``printed`` into ``read``, or None beyond ``most``."""
    by = _BY_READ
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        c = best[(i, j)]
        if i < len(read) and j < len(printed) and read[i] == printed[j]:
            nxt = [(i + 1, j + 1, c)]
        else:
            nxt = []
        if c < most:
            for n in (1, 2):
                for b in by.get(read[i : i + n], ()):
                    if len(read[i : i + n]) == n and printed.startswith(b, j):
                        nxt.append((i + n, j + len(b), c + 1))
        for a, b, k in nxt:
            if k < best.get((a, b), most + 1):
                best[(a, b)] = k
                todo.append((a, b))
    return best.get((len(read), len(printed)))


def misread(read: str, trie: Trie, least: float = 0, most: int = 2, costs: dict[tuple[str, str], float] | None = None) -> dict[str, tuple[int, int, float]]:
    """(fewest confusions, count, their cost) of every word of the trie counted at least ``least`` times from which at
    most ``most`` confusions make ``read``. A state is a place in ``read`` with the confusions so far, so one of
    several letters (a ligature, rn for m) costs no more than any other. Without ``costs`` each costs CONFUSED."""
    out: dict[str, tuple[int, int, float]] = {}
    stack = [("", trie.root, 0, 0, 0.0)]
    costs = costs or {}
    while stack:
        pre, node, i, c, cost = stack.pop()
        if i == len(read):
            if node[1] and node[1] >= least and (c, cost) < (out[pre][0], out[pre][2]) if pre in out else node[1] and node[1] >= least:
                out[pre] = (c, node[1], cost)
            continue
        steps = [(read[i], 1, 0, 0.0)]
        if c < most:
            steps += [(b, n, 1, costs.get((read[i : i + n], b), CONFUSED)) for n in (1, 2) if i + n <= len(read) for b in _BY_READ.get(read[i : i + n], ())]
        for b, n, k, w in steps:
            nxt = node
            for ch in b:
                nxt = nxt[0].get(ch)
                if nxt is None or nxt[2] < least:
                    break
            else:
                stack.append((pre + b, nxt, i + n, c + k, cost + w))
    return out


def confusion_of(read: str, printed: str) -> tuple[str, str] | None:
    """The single listed confusion that turns ``printed`` into ``read``, or None."""
    i = 0
    while i < min(len(read), len(printed)) and read[i] == printed[i]:
        i += 1
    for at in range(max(0, i - 1), i + 1):
        for n in (1, 2):
            for b in _BY_READ.get(read[at : at + n], ()):
                if len(read[at : at + n]) == n and printed == read[:at] + b + read[at + n :]:
                    return read[at : at + n], b
    return None


#: Scores of candidates by unlisted edits are set so far down, to be told apart.
UNSEEN = -1000.0


def candidates_of(word: str, own: int, trie: Trie, ratio: float = 25.0, costs: dict[tuple[str, str], float] | None = None) -> tuple[tuple[str, float], ...]:
    """(printed word, score) of every word of the trie that may have been read as ``word``, which itself is counted
    ``own`` times: all that up to two listed confusions explain, however many edits these are."""
    if len(word) < 2:
        return ()
    strange = not _WHOLE_WORD.fullmatch(word)
    base = float(max(own, 1)) if strange else ratio * (4.0 if len(word) < 4 else 1.0) * max(own, 0.5)
    out = []
    for v, (k, n, cost) in misread(word, trie, max(base, LEAST_COUNT), costs=costs).items():
        if v != word and len(v) > 1 and (strange or n >= base * ratio ** (k - 1)):
            out.append((v, math.log(n) - cost))
    return tuple(sorted(out, key=lambda x: (-x[1], x[0])))


def unlisted_of(word: str, own: int, trie: Trie, ratio: float = 25.0) -> tuple[tuple[str, float], ...]:
    """(printed word, score) of all words within one edit (two from nine letters) of an uncounted word, found by the
    Levenshtein automaton: for words in small letters that no listed confusion explains. They score below UNSEEN."""
    out = []
    if not own and len(word) >= 5 and _WHOLE_WORD.fullmatch(word):
        base = ratio * 0.5
        for v, e, n in LevenshteinAutomaton(word, 2 if len(word) >= 9 else 1).within(trie, base * ratio):
            if v != word and len(v) > 3:
                out.append((v, UNSEEN + math.log(n) - UNSEEN_EDIT * e))
    return tuple(sorted(out, key=lambda x: (-x[1], x[0])))


class Repairer:
    """Repair of single texts with a vocabulary, word pairs and header templates of the whole corpus."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int], templates: set[str], costs: dict[tuple[str, str], float] | None = None, found: dict[str, tuple[tuple[str, float], ...]] | None = None, ratio: float = 25.0):
        self.counts, self.pairs, self.templates, self.costs, self.ratio = counts, pairs, templates, costs or {}, ratio
        if found is None:
            self.trie = Trie(counts)
            self.candidates = lru_cache(maxsize=300_000)(lambda w: candidates_of(w, self.counts.get(w, 0), self.trie, self.ratio, self.costs))
            self.unlisted = lru_cache(maxsize=300_000)(lambda w: unlisted_of(w, self.counts.get(w, 0), self.trie, self.ratio))
        else:  # candidates looked up beforehand
            self.candidates = lambda w: tuple(x for x in found.get(w, ()) if x[1] > UNSEEN)
            self.unlisted = lambda w: tuple(x for x in found.get(w, ()) if x[1] <= UNSEEN)
        self.judged = lru_cache(maxsize=300_000)(self._judged)

    def _judged(self, core: str) -> tuple[bool, str | None]:
        """(whether neighbours must decide, else what was printed or None) of a word by itself."""
        low = core.lower()
        if _NET.search(core):
            return False, None
        number = self.number(core)
        if number is not None:
            return False, number if number != core else None
        if not _ANY_LETTER.search(core) or _CODE.fullmatch(core):
            return False, None
        if self.candidates(low) or core.islower() and self.unlisted(low):
            return True, None
        if len(core) > 3 and _SIGN_IN_WORD.fullmatch(core):
            return False, core.translate(_PLAIN)  # a name the vocabulary lacks: the sign's usual letter
        if "-" in low.strip("-"):
            parts = core.split("-")
            fixed = [self.fix(p, "", "") or p if len(p) > 2 else p for p in parts]
            return False, "-".join(fixed) if fixed != parts else None
        return False, None

    def fix(self, core: str, before: str, after: str) -> str | None:
        """What was printed for the word ``core`` between its neighbours, or None if it may stand."""
        open_, fixed = self.judged(core)
        if not open_:
            return fixed
        low = core.lower()
        best, score = None, -1e9
        for v, s in self.candidates(low) or self.unlisted(low):
            near = math.log1p(self.pairs.get((before, v), 0)) + math.log1p(self.pairs.get((v, after), 0))
            if s <= UNSEEN and not near:
                continue  # an edit that no list has needs a neighbour's word for it
            c = (s - UNSEEN if s <= UNSEEN else s) + 1.5 * near
            if c > score:
                best, score = v, c
        if best is None:
            return None
        own = self.counts.get(low, 0)
        if own:
            here = math.log(own) + 1.5 * math.log1p(self.pairs.get((before, low), 0)) + 1.5 * math.log1p(self.pairs.get((low, after), 0))
            if score <= here:
                return None
        if core.isupper() and len(core) > 1 and any(ch.isalpha() for ch in core) and sum(ch.isalpha() for ch in core) > 1:
            return best.upper()
        return best[0].upper() + best[1:] if core[0].isupper() else best

    @staticmethod
    def number(core: str) -> str | None:
        """A number read with letters in it as digits; None if it isn't a number."""
        m = _NUMERIC.fullmatch(core)
        if not m or not _HAS_DIGIT.search(m.group(2)):
            return None
        body = m.group(2)
        if re.fullmatch(r"\d[lIOo|]", body) and len(core) == 2 and body[1] in "o":
            return None
        return m.group(1) + body.translate(str.maketrans("lIOo|", "11001")) + m.group(3)

    def is_scan(self, text: str) -> bool:
        """Whether most line breaks come where the next word did not fit the text's width, at any width; a text of
        fewer than three lines, whose width says nothing, must split a known word over a line end."""
        lines = [x.rstrip() for x in text.split("\n")]
        if len(lines) < 2:
            return False
        prose = [x for x in lines if x.strip() and not _GAPS.search(x) and not _PAGE.match(x)]
        if len(prose) < 3:
            return any(self.splits(a, b) for a, b in zip(prose, prose[1:]))
        lens = sorted((len(x) for x in prose), reverse=True)
        # The text's width: the greatest length that several lines nearly reach, so one long header is none.
        width = next((n for k, n in enumerate(lens) if sum(n - 7 <= m <= n for m in lens) >= min(3, len(lens))), lens[0])
        # Misread letters shift widths a little; only a text with other marks of a scan gets that allowance.
        slack = 4 if any(_PAGE.match(x) or x[-1:] in HYPHENS and re.search(rf"[a-z][{HYPHENS}]$", x) for x in lines if x) else 1
        fits = wraps = 0
        for a, b in zip(lines, lines[1:]):
            if not a.strip() or not b.strip() or _PAGE.match(a) or _PAGE.match(b) or _GAPS.search(a):
                continue
            first = b.split()[0]
            if len(a) + 1 + len(first) > width - slack or a[-1] in HYPHENS:
                wraps += 1
            else:
                fits += 1
        return wraps >= 2 and wraps >= 2 * fits

    def splits(self, a: str, b: str) -> bool:
        """Whether a word that the corpus knows in one piece runs over the end of line ``a`` into ``b``."""
        if not _SPLIT.search(a) or not b.strip():
            return False
        left, right = a.split()[-1][:-1].strip(_EDGE).lower(), b.split()[0].strip(_EDGE).lower()
        return right.isalpha() and self.counts.get(left + right, 0) >= LEAST_COUNT and self.counts.get(left, 0) < self.counts[left + right]

    def template(self, line: str) -> str:
        """A line with its rare words and numbers masked and misread words repaired."""
        t = re.sub(r"\s+", " ", line.strip())
        t = re.sub(r"\s+[0-9lIOo]{1,4}$", "", t) if re.search(r"\S\s{2,}[0-9lIOo]{1,4}\s*$", line) else t
        out = []
        for tok in t.split(" "):
            core = tok.strip(_EDGE)
            if re.search(r"\d", core) and self.number(core) is not None:
                out.append("9")
                continue
            low = core.lower()
            if low and self.counts.get(low, 0) < LEAST_COUNT * 10:
                low = (self.fix(core, "", "") or core).lower()
            out.append(low if self.counts.get(low, 0) >= LEAST_COUNT * 10 or not re.search(r"\w", low) else "X")
        return " ".join(out)

    def header_evidence(self, text: str) -> set[str]:
        """Templates of lines that look like running headers: short, unended, by a page number or repeated."""
        if not self.is_scan(text):
            return set()
        lines = text.split("\n")
        seen = Counter(re.sub(r"\s+", " ", x.strip()) for x in lines if x.strip())
        out = set()
        for k, x in enumerate(lines):
            s = re.sub(r"\s+", " ", x.strip())
            if not self.headerlike(s):
                continue
            near = [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(lines)]
            if seen[s] > 1 or any(y.strip() and _PAGE.match(y) for y in near):
                out.add(self.template(x))
        return out

    @staticmethod
    def headerlike(s: str) -> bool:
        return 8 <= len(s) <= 70 and s[-1] not in ".,;:!?-¬‐­" and len(s.split()) >= 2 and not _PAGE.match(s) and s[0].isupper()

    def confusions(self, text: str, into: Counter) -> None:
        """Counts the confusions of words that have one candidate only, by a single confusion."""
        for tok in text.split():
            low = tok.strip(_EDGE).lower()
            found = self.candidates(low) if len(low) > 3 and not self.counts.get(low, 0) else ()
            if len(found) == 1 and found[0][1] > UNSEEN:
                c = confusion_of(low, found[0][0])
                if c:
                    into[c] += 1

    def findings(self, text: str) -> tuple[list[tuple[int, str, str]], str]:
        """(line, kind, fixed) of each noise, and the repaired text."""
        if not self.is_scan(text):
            return [], text
        lines = text.split("\n")
        out: list[tuple[int, str, str]] = []
        kind: list[str] = []
        seen = Counter(re.sub(r"\s+", " ", x.strip()) for x in lines if x.strip())
        for k, x in enumerate(lines):
            s = re.sub(r"\s+", " ", x.strip())
            if not s:
                kind.append("blank")
            elif _PAGE.match(x):
                kind.append("page_number")
                out.append((k, "page_number", ""))
            elif self.headerlike(s) and self.template(x) in self.templates:
                kind.append("header")
                out.append((k, "header", ""))
            else:
                kind.append("text")
        body = [k for k, y in enumerate(kind) if y == "text"]
        nxt = {a: b for a, b in zip(body, body[1:])}
        toks = {k: lines[k].split() for k in body}
        pieces: dict[int, list[str]] = {k: list(v) for k, v in toks.items()}
        flat = [(k, j) for k in body for j in range(len(toks[k]))]
        place = {p: n for n, p in enumerate(flat)}
        core_of = lambda p: toks[p[0]][p[1]].strip(_EDGE)
        joined: set[tuple[int, int]] = set()
        for k in body:
            last = toks[k][-1] if toks[k] else ""
            if len(last) < 2 or last[-1] not in HYPHENS or not last[-2].isalpha() or k not in nxt or not toks[nxt[k]]:
                continue
            head = toks[nxt[k]][0]
            if not head[0].isalpha():
                continue
            left, right = last[:-1].lstrip(_EDGE), head.strip(_EDGE)
            whole = self.join(left, right, last[-1])
            out.append((k, "hyphen", whole))
            pieces[k][-1] = last[: len(last) - len(last[:-1].lstrip(_EDGE)) - 1] + whole + head[len(head.rstrip(_EDGE)) :]
            pieces[nxt[k]] = pieces[nxt[k]][1:] if pieces[nxt[k]] and pieces[nxt[k]][0] == head else pieces[nxt[k]]
            joined |= {(k, len(toks[k]) - 1), (nxt[k], 0)}
        done: set[tuple[int, str]] = set()
        for p in flat:
            if p in joined:
                continue
            tok = toks[p[0]][p[1]]
            core = tok.strip(_EDGE)
            if not core:
                continue
            n = place[p]
            before = core_of(flat[n - 1]).lower() if n else ""
            after = core_of(flat[n + 1]).lower() if n + 1 < len(flat) else ""
            fixed = self.fix(core, before, after)
            if fixed is None or fixed == core:
                continue
            at = len(pieces[p[0]]) - (len(toks[p[0]]) - p[1])
            if 0 <= at < len(pieces[p[0]]):
                pieces[p[0]][at] = tok.replace(core, fixed)
            if (p[0], fixed) not in done:
                done.add((p[0], fixed))
                out.append((p[0], "char", fixed))
        for k, what in enumerate(kind):  # words of running headers; the page's number is left alone
            if what == "header":
                own = lines[k].split()
                if re.search(r"\S\s{2,}[0-9lIOo]{1,4}\s*$", lines[k]):
                    own = own[:-1]
                for tok in own:
                    core = tok.strip(_EDGE)
                    fixed = self.fix(core, "", "") if core else None
                    if fixed is not None and fixed != core and (k, fixed) not in done:
                        done.add((k, fixed))
                        out.append((k, "char", fixed))
        return sorted(out), self.reflow(lines, kind, pieces)

    def join(self, left: str, right: str, mark: str) -> str:
        """The word of two parts in one piece; a hyphen stays if the corpus writes the word with it."""
        one, two = left + right, left + "-" + right
        a, b = self.counts.get(one.lower(), 0), self.counts.get(two.lower(), 0)
        if a == b == 0:
            fa, fb = self.candidates(one.lower()), self.candidates(two.lower())
            if fa and (not fb or fa[0][1] >= fb[0][1]):
                return (fa[0][0][0].upper() if one[0].isupper() else fa[0][0][0]) + fa[0][0][1:]
            if fb:
                return (fb[0][0][0].upper() if two[0].isupper() else fb[0][0][0]) + fb[0][0][1:]
            parts = mark == "-" and (right[:1].isupper() or (self.counts.get(left.lower().split("-")[-1], 0) >= LEAST_COUNT and self.counts.get(right.lower().split("-")[0], 0) >= LEAST_COUNT))
            return two if parts or "-" in right else one
        return two if b > a else one

    @staticmethod
    def reflow(lines: list[str], kind: list[str], pieces: dict[int, list[str]]) -> str:
        paras: list[list[str]] = [[]]
        for k, what in enumerate(kind):
            if what == "text":
                paras[-1] += pieces[k]
            elif what == "blank":
                ended = paras[-1] and paras[-1][-1].rstrip("\"”)»")[-1:] in ".!?…:"
                if ended and paras[-1]:
                    paras.append([])
        return "\n\n".join(" ".join(p) for p in paras if p)


def _words(c: Column) -> Column:
    joined = F.regexp_replace(c, r"[-‐¬­]\s*\n\s*", "\u0001")
    return F.regexp_extract_all(F.lower(joined), F.lit(r"(?<![\p{L}\d+|\u0001])[\p{L}]+(?:['’-][\p{L}]+)*(?![\p{L}\d+|\u0001])"), F.lit(0))


def learn_language(chunks: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Word and neighbour counts of all texts; words cut at a line end don't count."""
    w = shared_checkpoint(chunks.where(F.col(content).isNotNull()).select(_words(F.col(content)).alias("ws")))
    words = w.select(F.explode("ws").alias("w")).groupBy("w").count().where(F.col("count") >= LEAST_COUNT)
    two = w.where(F.size("ws") > 1).select(F.explode(F.arrays_zip(F.slice("ws", 1, F.size("ws") - 1).alias("a"), F.slice("ws", 2, F.size("ws") - 1).alias("b"))).alias("p"))
    pairs = two.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().where(F.col("count") >= LEAST_COUNT)
    return words, pairs


def learned_costs(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Cost of each listed confusion: CONFUSED on the average of those seen, less for frequent ones by the logarithm of
    their share, at most one more for those never seen."""
    n = sum(counts.values())
    if not n:
        return {}
    k = len(CONFUSIONS)
    return {c: CONFUSED + max(-1.0, min(1.0, 0.25 * math.log((n + k) / k / (counts.get(c, 0) + 1)))) for c in CONFUSIONS}


_FINDINGS = "repaired string, findings array<struct<line_no:int,noise_kind:string,fixed:string>>"


def repair_scans(chunks: DataFrame, chunk_id: str = "chunk_id", content: str = "content") -> DataFrame:
    """chunk_id, repaired, findings (array of line_no, noise_kind, fixed), one row a distinct id and text.

    Words, word pairs and header templates of the corpus travel with the tasks up to MOST_WORDS, MOST_PAIRS and
    MOST_TEMPLATES; beyond that each text gets its own by joins (``_repair_joined``), with the same result.
    """
    src = shared_checkpoint(spread(chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(content).alias("content")).where("chunk_id is not null").dropDuplicates(["chunk_id", "content"])))
    words, pairs = (shared_checkpoint(x) for x in learn_language(src))
    if words.limit(MOST_WORDS + 1).count() > MOST_WORDS or pairs.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        return _repair_joined(src, words, pairs)
    counts = {r["w"]: r["count"] for r in bounded_rows(words, MOST_WORDS, "vocabulary")}
    pair_counts = {(r["a"], r["b"]): r["count"] for r in bounded_rows(pairs, MOST_PAIRS, "word pairs")}

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep = Repairer(counts, {}, set())
        for p in batches:
            yield _evidence((rep, t) for t in p["content"])

    seen = shared_checkpoint(_summed(src.mapInPandas(evidence, "kind string, a string, b string, n bigint")))
    costs = _costs(seen)
    found = _templates(seen)
    if found.limit(MOST_TEMPLATES + 1).count() > MOST_TEMPLATES:
        return _repair_joined(src, words, pairs)
    templates = {r["t"] for r in bounded_rows(found, MOST_TEMPLATES, "header templates")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep = Repairer(counts, pair_counts, templates, costs)
        for p in batches:
            yield pd.DataFrame([_row(rep, i, t) for i, t in zip(p["chunk_id"], p["content"])], columns=["chunk_id", "repaired", "findings"])

    return src.mapInPandas(run, f"chunk_id {src.schema['chunk_id'].dataType.simpleString()}, {_FINDINGS}")


def _row(rep: Repairer, i: object, t: object) -> tuple:
    f, fixed = rep.findings(t) if isinstance(t, str) else ([], None)
    return i, fixed, [{"line_no": a, "noise_kind": b, "fixed": c} for a, b, c in f]


def _evidence(texts) -> pd.DataFrame:
    """Header templates ('t') and confusions ('c') of texts, summed within the batch."""
    heads: Counter = Counter()
    conf: Counter = Counter()
    for rep, t in texts:
        if isinstance(t, str) and rep.is_scan(t):
            heads.update(rep.header_evidence(t))
            rep.confusions(t, conf)
    return pd.DataFrame([("t", t, "", n) for t, n in heads.items()] + [("c", a, b, n) for (a, b), n in conf.items()], columns=["kind", "a", "b", "n"])


def _summed(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _costs(seen: DataFrame) -> dict[tuple[str, str], float]:
    return learned_costs({(r["a"], r["b"]): r["n"] for r in bounded_rows(seen.where("kind = 'c'"), len(CONFUSIONS), "confusions")})


def _templates(seen: DataFrame) -> DataFrame:
    """Templates that stand in several texts, so that one odd line makes no header."""
    return seen.where("kind = 't' and n >= 3 and a <> 'X' and a rlike '[a-z]'").select(F.col("a").alias("t"))


def words_needed(text: str) -> set[str]:
    """Every word of a text whose count or candidates its repair may ask for."""
    toks = [t.strip(_EDGE).lower() for t in text.split()]
    out = set(toks)
    for w in toks:
        out |= set(w.split("-"))
    ends = [(a.split(), b) for a in text.split("\n") if a.split() and a.split()[-1][-1] in HYPHENS for b in {x.split()[0] for x in text.split("\n") if x.split()}]
    for own, head in ends:
        left, right = own[-1][:-1].lstrip(_EDGE).lower(), head.strip(_EDGE).lower()
        out |= {left, left.strip(_EDGE), right, left + right, left.strip(_EDGE) + right, left + "-" + right, left.split("-")[-1], right.split("-")[0]}
    out.discard("")
    return out


def pairs_needed(text: str, found: dict[str, tuple[tuple[str, float], ...]]) -> set[tuple[str, str]]:
    """Every pair of neighbours whose count the ranking of a text's candidates may ask for. Furniture may be taken out
    between two words, so words of lines beyond are neighbours too."""
    lines = [[t.strip(_EDGE).lower() for t in x.split()] for x in text.split("\n") if x.strip()]
    out: set[tuple[str, str]] = set()

    def add(x: str, y: str) -> None:
        out.update((x, v) for v in (y, *(v for v, _ in found.get(y, ()))))
        out.update((v, y) for v in (x, *(v for v, _ in found.get(x, ()))))

    for k, own in enumerate(lines):
        for x, y in zip(own, own[1:]):
            add(x, y)
        for nxt in lines[k + 1 : k + 5]:
            add(own[-1], nxt[0])
    return out


def _repair_joined(src: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``repair_scans`` with a vocabulary of any size. Candidates are looked up once for each distinct word, in parts
    of the vocabulary that fit a task; words, candidates, pairs and templates then reach each text by joins."""
    kind = src.schema["chunk_id"].dataType.simpleString()
    texts = src.where("content is not null").select(F.xxhash64("content").alias("h"), "content").dropDuplicates(["h"])

    def need_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(h, w) for h, t in zip(p["h"], p["content"]) for w in sorted(words_needed(t))], columns=["h", "w"])

    need = shared_checkpoint(texts.mapInPandas(need_words, "h bigint, w string"))
    asked = shared_checkpoint(need.select("w").distinct().join(words, "w", "left").select("w", F.coalesce("count", F.lit(0)).alias("own")))
    parts = -(-words.count() // MOST_WORDS) or 1

    def looked_up(costs: dict) -> DataFrame:
        out = None
        for k in range(parts):
            vocabulary = {r["w"]: r["count"] for r in bounded_rows(words.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == k), 2 * MOST_WORDS, "part of the vocabulary")}

            def run(batches: Iterator[pd.DataFrame], vocabulary=vocabulary) -> Iterator[pd.DataFrame]:
                trie = Trie(vocabulary)
                for p in batches:
                    yield pd.DataFrame([(w, v, s) for w, own in zip(p["w"], p["own"]) for v, s in (*candidates_of(w, int(own), trie, costs=costs), *unlisted_of(w, int(own), trie))], columns=["w", "v", "s"])

            part = asked.mapInPandas(run, "w string, v string, s double")
            out = part if out is None else out.unionByName(part)
        # Unlisted edits count only for words that no listed confusion explains in any part.
        listed = out.groupBy("w").agg(F.max("s").alias("m"))
        out = out.join(listed, "w").where(f"s > {UNSEEN} or m <= {UNSEEN}")
        named = out.join(words.select(F.col("w").alias("v"), "count"), "v").groupBy("w").agg(F.collect_list(F.struct("v", "s", "count")).alias("found"))
        own = need.join(asked, "w").join(named, "w", "left").groupBy("h").agg(F.collect_list(F.struct("w", "own", "found")).alias("known"))
        return texts.join(own, "h", "left")

    def local(known: object) -> tuple[dict, dict]:
        counts, found = {}, {}
        for r in known if known is not None else ():
            if r["own"]:
                counts[r["w"]] = r["own"]
            if r["found"] is not None and len(r["found"]):
                found[r["w"]] = tuple(sorted(((x["v"], x["s"]) for x in r["found"]), key=lambda x: (-x[1], x[0])))
                counts.update({x["v"]: x["count"] for x in r["found"]})
        return counts, found

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            made = []
            for t, known in zip(p["content"], p["known"]):
                counts, found = local(known)
                made.append((Repairer(counts, {}, set(), found=found), t))
            yield _evidence(made)

    # Repeated texts count as often as they stand in the corpus.
    times = src.where("content is not null").groupBy(F.xxhash64("content").alias("h")).agg(F.count("*").alias("times"))
    first = looked_up({}).join(times, "h").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    seen = shared_checkpoint(_summed(first.select("content", "known").mapInPandas(evidence, "kind string, a string, b string, n bigint")))
    ready = shared_checkpoint(looked_up(_costs(seen)))

    def need_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(h, a, b) for h, t, k in zip(p["h"], p["content"], p["known"]) for a, b in sorted(pairs_needed(t, local(k)[1]))], columns=["h", "a", "b"])

    def need_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for h, t, k in zip(p["h"], p["content"], p["known"]):
                counts, found = local(k)
                rep = Repairer(counts, {}, set(), found=found)
                out += [(h, x) for x in sorted({rep.template(x) for x in t.split("\n") if x.strip()})] if rep.is_scan(t) else []
            yield pd.DataFrame(out, columns=["h", "t"])

    two = ready.mapInPandas(need_pairs, "h bigint, a string, b string").join(pairs, ["a", "b"]).groupBy("h").agg(F.collect_list(F.struct("a", "b", "count")).alias("two"))
    heads = ready.mapInPandas(need_heads, "h bigint, t string").join(_templates(seen), "t").groupBy("h").agg(F.collect_set("t").alias("heads"))
    full = src.withColumn("h", F.xxhash64("content")).join(ready.select("h", "known"), "h", "left").join(two, "h", "left").join(heads, "h", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for i, t, k, two_, heads_ in zip(p["chunk_id"], p["content"], p["known"], p["two"], p["heads"]):
                counts, found = local(k)
                pc = {(r["a"], r["b"]): r["count"] for r in (two_ if two_ is not None else ())}
                rows.append(_row(Repairer(counts, pc, set(heads_ if heads_ is not None else ()), found=found), i, t))
            yield pd.DataFrame(rows, columns=["chunk_id", "repaired", "findings"])

    return full.select("chunk_id", "content", "known", "two", "heads").mapInPandas(run, f"chunk_id {kind}, {_FINDINGS}")

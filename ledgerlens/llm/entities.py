"""Variant spellings of names of companies and sole traders, linked by entity.

Merge-and-rematch resolution: profiles that share a blocking key and match are merged, the merged profile
holds the union of their spellings and initials, and enters blocking again under all its keys, until a
round merges nothing.

Defined results: null names are left out; blank and sign-only names are entities of their own; equal
strings are one name; an entity of one spelling has no pair; an empty input gives no rows. A name that
lacks the word telling two sisters apart and fits both stays on its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import shared_checkpoint, spread

# Legal forms, lines of business, trades, additions, and short forms of given names.
FORMS = {
    "llc": ["llc"], "plc": ["plc"], "gmbh": ["gmbh"], "sa": ["sa"], "ag": ["ag"], "nv": ["nv"], "bv": ["bv"], "llp": ["llp"], "lp": ["lp"], "kg": ["kg"], "oy": ["oy"], "ab": ["ab"],
    "company": ["company", "co"], "corporation": ["corporation", "corp"], "limited": ["limited", "ltd"], "incorporated": ["incorporated", "inc", "incorp"],
}
LINES = {
    "construction": ["constr", "cons"], "insurance": ["ins", "insur"], "pharmaceuticals": ["pharma", "pharm"], "distribution": ["distrib", "distr", "dist"], "chemicals": ["chem", "chems"],
    "shipping": ["shpg", "ship"], "engineering": ["eng", "engrg", "engg"], "energy": ["enrgy", "nrg"], "logistics": ["logist", "log"], "textiles": ["txtls", "text"], "manufacturing": ["mfg", "manuf", "manufg"],
    "technologies": ["tech", "techs", "technology"], "properties": ["props", "prop"], "foods": ["fds", "food"], "international": ["intl", "int"], "brothers": ["bros"], "holdings": ["hldgs", "holding", "hldg"],
    "laboratories": ["labs", "lab"], "industries": ["inds", "ind"], "services": ["svcs", "serv"], "solutions": ["soln", "solns"], "systems": ["sys"], "partners": ["ptnrs"], "resources": ["res"], "trading": ["trdg"],
    "consulting": ["cons"], "electronics": ["elec"], "motors": ["mtrs"], "airlines": ["air"], "mining": ["mng"], "media": [], "capital": ["cap"], "finance": ["fin"],
}
TRADES = {
    "bakery": ["bkry"], "nursery": ["nrsry"], "joinery": ["jnry"], "motors": ["mtrs"], "tailors": ["tlrs"], "printing": ["printg", "prtg"], "bookkeeping": ["bkkpg"], "plumbing": ["plmbg"], "florist": ["flrst"],
    "catering": ["catrg", "ctrg"], "roofing": ["rfg"], "cleaning": ["clng"], "garage": ["grge"], "salon": [], "butchers": ["btchrs"], "cafe": [], "gardens": ["gdns"], "painting": ["pntg"], "electrical": ["elec"],
}
NICKNAMES = {
    "alexandra": ["alex", "sandra", "lexi"], "alexander": ["alex", "sandy"], "andrew": ["drew", "andy"], "anthony": ["tony"], "benjamin": ["ben"], "charles": ["charlie", "chuck", "chas"], "christopher": ["chris", "kit"],
    "christine": ["chris", "tina"], "daniel": ["dan", "danny"], "david": ["dave"], "deborah": ["debbie", "deb"], "edward": ["ed", "ted", "eddie", "ned"], "elizabeth": ["liz", "beth", "betty", "eliza"], "frederick": ["fred", "freddie"],
    "gregory": ["greg"], "james": ["jim", "jimmy", "jamie"], "jennifer": ["jenny", "jen"], "john": ["jack", "johnny"], "jonathan": ["jon", "jonny"], "joseph": ["joe", "joey"], "katherine": ["kate", "kathy", "katie", "kay"],
    "lawrence": ["larry"], "margaret": ["maggie", "peggy", "meg"], "matthew": ["matt"], "michael": ["mike", "mick", "mickey"], "nicholas": ["nick"], "pamela": ["pam"], "patricia": ["trish", "pat", "patty"], "patrick": ["pat", "paddy"],
    "peter": ["pete"], "philip": ["phil"], "rebecca": ["becky"], "richard": ["dick", "rick", "rich"], "robert": ["bob", "rob", "bobby"], "ronald": ["ron"], "samuel": ["sam"], "samantha": ["sam"], "stephen": ["steve"], "steven": ["steve"],
    "susan": ["sue", "susie"], "theodore": ["ted", "theo"], "thomas": ["tom", "tommy"], "timothy": ["tim"], "victoria": ["vicky", "tori"], "victor": ["vic"], "walter": ["walt"], "william": ["bill", "will", "billy"], "george": [], "mary": ["molly", "polly"],
    "sarah": ["sally"], "helen": ["nell"], "barbara": ["barb"], "dorothy": ["dot", "dolly"], "henry": ["harry", "hank"], "kenneth": ["ken"], "donald": ["don"], "gerald": ["gerry", "jerry"], "raymond": ["ray"], "stanley": ["stan"], "vincent": ["vince"],
}
ADDED = re.compile(r"\((?:hq|head office|group|uk|consolidated)\)|[-–—]\s*consolidated\b|\bconsolidated$|\bgroup$|^the\s+", re.I)
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
BLOCK = 400

_FORM_OF = {w: k for k, ws in FORMS.items() for w in ws}
_GIVEN: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _w in (_full, *_short):
        _GIVEN.setdefault(_w, set()).add(_full)


@lru_cache(maxsize=500_000)
def near(a: str, b: str, most: int = 1) -> bool:
    """Whether at most ``most`` insertions, deletions, substitutions or swaps of neighbours lie between."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 3:
        return False
    prev2, prev = [], list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return False
        prev2, prev = prev, cur
    return prev[-1] <= most


def kind_word(w: str, table: dict[str, list[str]]) -> str | None:
    """The entry a word stands for: itself, a listed short form, or one typing error off the long form."""
    for k, short in table.items():
        if w == k or w in short:
            return k
    if len(w) >= 5:
        for k in table:
            if near(w, k) or (len(w) >= 8 and near(w, k, 2)):
                return k
    return None


def parse(name: str) -> dict:
    """A name as a profile of one spelling."""
    t = unicodedata.normalize("NFKC", name).strip()
    t = re.sub(r"\s+", " ", t)
    t = ADDED.sub(" ", t).strip(" ,-–—")
    t = ADDED.sub(" ", t).strip(" ,-–—")
    out = parse_trader(t) or parse_company(t)
    return out if any(out["base"]) else {"k": "blank", "base": [], "name": name}


def parse_company(t: str) -> dict:
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t)
    low = t.lower()
    low = re.sub(r"\bg\.?\s?m\.?\s?b\.?\s?h\b\.?", "gmbh", low)
    low = re.sub(r"\b([lspna])\.\s?([lavcgb])\.\s?([cp])\.?(?!\w)", r"\1\2\3", low)
    low = re.sub(r"\b([sanb])\.\s?([avg])\.(?!\w)", r"\1\2", low)
    words = re.findall(r"[^\W_]+", low)
    form = line = None
    num = 0
    base: list[str] = []
    for k, w in enumerate(words):
        f = _FORM_OF.get(w) or (next((x for x in ("company", "corporation", "limited", "incorporated") if len(w) >= 6 and near(w, x)), None))
        if f and form is None and (k > 0 or len(w) > 2):
            form = f
            continue
        if w in ROMAN and len(w) > 1 or w.isdigit():
            num = ROMAN.get(w) or int(w)
            continue
        n = kind_word(w, LINES)
        if n and line is None and len(words) > 1:
            line = n
            continue
        base.append(w)
    return {"k": "c", "base": base, "line": line, "num": num, "form": form}


def parse_trader(t: str) -> dict | None:
    m = re.match(r"^(.*?)\s+(?:t/a|dba|d/b/a|trading as|t\.a\.)\s+(.*)$", t, re.I)
    person = trade = None
    if m:
        person, trade = m.group(1), m.group(2)
    else:
        m = re.match(r"^(.*?)\s*\((.+)\)$", t)
        if m and kind_word(re.findall(r"[^\W_]+", m.group(1).lower() or "x")[-1] if re.findall(r"[^\W_]+", m.group(1)) else "", TRADES):
            trade, person = m.group(1), m.group(2)
    if person is None:
        words = re.findall(r"[^\W_]+", t.lower())
        if len(words) >= 4 and kind_word(words[-1], TRADES) and not any(w in _FORM_OF for w in words):
            n = len(words) - 2
            person, trade = " ".join(t.split()[:n]), " ".join(words[n:])
        elif 2 <= len(words) <= 3 and any(w in _GIVEN for w in (words[0], words[-1])) and not any(w in _FORM_OF or kind_word(w, LINES) for w in words):
            person, trade = t, ""
        else:
            return None
    given, surname = person_parts(person)
    tw = re.findall(r"[^\W_]+", (trade or "").lower())
    typ = kind_word(tw[-1], TRADES) if tw else None
    return {"k": "t", "given": given, "base": [surname], "trade": "".join(tw[:-1] if typ else tw), "typ": typ}


def person_parts(p: str) -> tuple[list[str], str]:
    """(given names and initials, surname) of a person's name in either order."""
    if "," in p:
        last, _, first = p.partition(",")
        return re.findall(r"[^\W_]+", first.lower()), "".join(re.findall(r"[^\W_]+", last.lower()))
    w = re.findall(r"[^\W_]+", p.lower())
    if not w:
        return [], ""
    if len(w) > 1 and (w[-1] in _GIVEN or len(w[-1]) == 1) and w[0] not in _GIVEN and len(w[0]) > 1:
        return w[1:], w[0]
    return w[:-1], w[-1]


def given_fit(a: list[str], b: list[str]) -> bool:
    """Whether first given names can be one person's: equal, short form, typing error or initial."""
    if not a or not b:
        return True
    x, y = a[0], b[0]
    if x == y or x[0] == y[0] and (len(x) == 1 or len(y) == 1):
        return True
    if _GIVEN.get(x, {x}) & _GIVEN.get(y, {y}):
        return True
    return any(len(u) == 1 and u == f[0] for u, v in ((x, y), (y, x)) for f in _GIVEN.get(v, ())) or (len(x) > 3 and near(x, y))


def bases_fit(a: list[str], b: list[str]) -> bool:
    """Whether name words agree: in either order, an initial for a word, or written together."""
    if not a or not b:
        return False
    if len(a) == len(b) == 1:
        return near(a[0], b[0], 1 if len(a[0]) < 12 else 2)
    if len(a) == len(b):
        for other in ([b, b[::-1]] if len(b) == 2 else [b]):
            full = fit = 0
            for x, y in zip(a, other):
                if len(x) == 1 or len(y) == 1:
                    fit += x[0] == y[0]
                elif near(x, y):
                    fit += 1
                    full += 1
            if fit == len(a) and full:
                return True
        return False
    one, more = (a, b) if len(a) < len(b) else (b, a)
    if len(one) == 1 and len(one[0]) >= 8 and len(more) == 2:
        return near(one[0], "".join(more), 2) or near(one[0], "".join(more[::-1]), 2)
    return False


def spellings_fit(a: dict, b: dict) -> bool:
    if a["k"] != b["k"]:
        return False
    if a["k"] == "t":
        if not near(a["base"][0], b["base"][0]) or not given_fit(a["given"], b["given"]):
            return False
        return not a["trade"] or not b["trade"] or near(a["trade"], b["trade"])
    return bases_fit(a["base"], b["base"])


def known(p: list[dict], what: str) -> set:
    return {v[what] for v in p if v.get(what)}


def complete(p: list[dict]) -> bool:
    return bool(known(p, "trade")) if p[0]["k"] == "t" else bool(known(p, "line"))


def signature(p: list[dict]) -> tuple:
    """What a profile knows that another one can contradict."""
    if p[0]["k"] == "c":
        return "c", frozenset(known(p, "line")), frozenset(known(p, "form")), frozenset(v["num"] for v in p)
    return p[0]["k"], frozenset(known(p, "typ")), frozenset(v["given"][0] for v in p if v["given"])


@lru_cache(maxsize=500_000)
def agree(a: tuple, b: tuple) -> bool:
    """Whether nothing in two signatures contradicts."""
    if a[0] != b[0]:
        return False
    if a[0] == "c":
        return not any(x and y and not x & y for x, y in zip(a[1:3], b[1:3])) and (a[3] == b[3] or bool(a[3] & b[3]))
    return not (a[1] and b[1] and not a[1] & b[1]) and all(given_fit([u], [v]) for u in a[2] for v in b[2])


def profiles_fit(a: list[dict], b: list[dict]) -> bool:
    """Whether any two spellings fit and nothing that the profiles know contradicts."""
    return agree(signature(a), signature(b)) and any(spellings_fit(u, v) for u in a for v in b)


def keys_of(p: list[dict]) -> set[str]:
    """Blocking keys: a name word with one letter dropped, with the other word's initial; the words written
    together likewise."""
    out: set[str] = set()

    def dropped(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    for v in p:
        base = [w for w in v["base"] if w]
        if not base:
            continue
        if v["k"] == "t":
            for w in base:
                out |= {f"t{d}" for d in dropped(w)}
            continue
        if len(base) == 2:
            for x, y in (base, base[::-1]):
                if len(x) > 1:
                    out |= {f"c{d}|{y[0]}" for d in dropped(x)}
            if min(map(len, base)) > 1:
                for s in ("".join(base), "".join(base[::-1])):
                    out |= {f"g{d}" for d in dropped(s)}
        else:
            out |= {f"g{d}" for d in dropped("".join(base))}
    return out


def merge_block(rows: list[tuple[int, list[dict]]]) -> list[tuple[int, int]]:
    """Links within one block: every record against the merged profiles so far, complete ones first; a
    record that lacks the telling word links only if exactly one profile fits."""
    links: list[tuple[int, int]] = []
    merged: list[tuple[int, list[dict]]] = []
    for e, p in sorted((r for r in rows if complete(r[1])), key=lambda r: r[0]):
        fits = [k for k, (_, q) in enumerate(merged) if profiles_fit(p, q)]
        if not fits:
            merged.append((e, list(p)))
            continue
        first = merged[fits[0]]
        links.append((first[0], e))
        first[1].extend(v for v in p if v not in first[1])
        for k in reversed(fits[1:]):
            if profiles_fit(first[1], merged[k][1]):
                links.append((first[0], merged[k][0]))
                first[1].extend(v for v in merged[k][1] if v not in first[1])
                del merged[k]
    loose: list[tuple[int, list[dict]]] = []
    for e, p in sorted((r for r in rows if not complete(r[1])), key=lambda r: r[0]):
        fits = [q for q in merged if profiles_fit(p, q[1])]
        if len(fits) == 1:
            links.append((fits[0][0], e))
        elif not fits:
            loose.append((e, p))
    for n, (e, p) in enumerate(loose):
        same = next((f for f, q in loose[:n] if profiles_fit(p, q)), None)
        if same is not None:
            links.append((same, e))
    return links


def across(left: list[tuple[int, list[dict]]], right: list[tuple[int, list[dict]]] | None, step: str) -> list[tuple[int, int]]:
    """Every fit between two parts of a block (or within one, if ``right`` is None), told as little as the
    step needs: ``complete`` the smallest fit of each profile; ``fits`` up to two complete profiles for each
    incomplete one; ``loose`` the smallest fit of each profile among the smaller ones."""
    own: dict[tuple, list[tuple[int, list[dict]]]] = {}
    other: dict[tuple, list[tuple[int, list[dict]]]] = {}
    for rows, by in ((left, own), (left if right is None else right, other)):
        for e, p in rows:
            by.setdefault((complete(p), signature(p)), []).append((e, p))
    out: dict[int, set[int]] = {}

    def add(x: int, y: int) -> None:
        if step == "fits":
            if len(out.setdefault(x, set())) < 2:
                out[x].add(y)
        elif step == "complete" or y < x:
            out[x] = {min(y, *out.get(x, {y}))}

    for (ca, sa), ps in own.items():
        for (cb, sb), qs in other.items():
            if (step == "fits") == (ca == cb) or not agree(sa, sb):
                continue
            for e, p in ps:
                for f, q in qs:
                    if e == f or right is None and step != "fits" and e > f or step == "fits" and len(out.get(f if ca else e, ())) > 1:
                        continue
                    if any(spellings_fit(u, v) for u in p for v in q):
                        if step == "fits":
                            add(*((f, e) if ca else (e, f)))
                        else:
                            add(e, f)
                            add(f, e)
    return [(x, y) for x, ys in out.items() for y in sorted(ys)]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): the smallest label travels until nothing changes."""
    both = shared_checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = shared_checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        far = both.join(lab.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        jump = lab.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = shared_checkpoint(lab.join(far, "node").join(jump, "root", "left").select("node", "root", F.least("root", "m", F.coalesce("up", "root")).alias("nr")))
        if new.where("nr < root").limit(1).count() == 0:
            return lab
        lab = new.select("node", F.col("nr").alias("root"))


def resolve_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, entity_id) of the distinct non-null strings of a column."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"name": p["name"], "v": [json.dumps(parse(n), sort_keys=True, ensure_ascii=False) for n in p["name"]]})

    recs = shared_checkpoint(spread(names.select(F.col(name).cast("string").alias("name")).where("name is not null").distinct()).mapInPandas(parsed, "name string, v string").withColumn("ent", F.xxhash64("v")))
    prof = shared_checkpoint(recs.groupBy("ent").agg(F.array(F.first("v")).alias("vs")))
    owner = recs.select("name", "ent")

    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), names.sparkSession.sparkContext.defaultParallelism)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Keys with the profile's id alone; profiles are fetched once a block that is compared."""
        for p in batches:
            out = []
            for e, vs in zip(p["ent"], p["vs"]):
                own = [json.loads(v) for v in vs]
                whole = complete(own)
                out += [(k, e, whole) for k in sorted(keys_of(own))]
            yield pd.DataFrame(out, columns=["key", "ent", "whole"])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of blocks that lie together in key order; a block may run over batches."""
        decode = lru_cache(maxsize=100_000)(json.loads)

        def links(rows: list[tuple[int, tuple[str, ...]]]) -> list[tuple[int, int]]:
            return [] if len(rows) < 2 else merge_block([(e, [dict(decode(v)) for v in vs]) for e, vs in rows])

        at, rows = None, []
        for p in batches:
            out: list[tuple[int, int]] = []
            for key, part, e, vs in zip(p["key"], p["part"], p["ent"], p["vs"]):
                if (key, part) != at:
                    out += links(rows)
                    at, rows = (key, part), []
                rows.append((int(e), tuple(vs)))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(links(rows), columns=["a", "b"]).astype("int64")

    def crossed(hot: DataFrame, step: str) -> DataFrame:
        """(key, a, b) of ``across`` for every pair of parts of the blocks, each pair a task of its own."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            decode = lru_cache(maxsize=100_000)(json.loads)

            def fits(at: tuple, rows: list[tuple]) -> pd.DataFrame:
                sides: dict[int, list] = {}
                for part, e, vs in rows:
                    sides.setdefault(part, []).append((e, [decode(v) for v in vs]))
                one = at and at[1] == at[2]
                got = across(sides.get(at[1], []), None if one else sides.get(at[2], []), step) if rows else []
                return pd.DataFrame([(at[0], x, y) for x, y in got], columns=["key", "a", "b"]).astype({"a": "int64", "b": "int64"})

            at, rows = None, []
            for p in batches:
                for key, i, j, part, e, vs in zip(p["key"], p["i"], p["j"], p["part"], p["ent"], p["vs"]):
                    if (key, i, j) != at:
                        if rows:
                            yield fits(at, rows)
                        at, rows = (key, i, j), []
                    rows.append((part, int(e), tuple(vs)))
            if rows:
                yield fits(at, rows)

        dealt = hot.withColumn("part", F.pmod(F.xxhash64("ent"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        laid = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "ent", "vs")
        return laid.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "key string, a bigint, b bigint")

    def once(blocks: DataFrame) -> DataFrame:
        """One key of those that hold the same profiles (by number and two hashes of their ids)."""
        return blocks.groupBy("n", "s", "x").agg(F.min("key").alias("key"))

    def missed(k: DataFrame, size: DataFrame) -> DataFrame | None:
        """Links in blocks beyond BLOCK profiles that their parts did not show: first of complete profiles,
        and only if there is none, of incomplete ones, whose fits are counted over the whole block."""
        large = size.where(F.col("n") > BLOCK)
        if large.limit(1).count() == 0:
            return None
        hot = shared_checkpoint(k.join(once(large).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).select("key", "parts"), "key").join(prof, "ent").select("key", "parts", "ent", "whole", "vs"))
        least = shared_checkpoint(crossed(hot.where("whole"), "complete").groupBy("a").agg(F.min("b").alias("b")))
        if least.limit(1).count():
            # A profile below all its fits is compared with those that fit none smaller, as a block of its own.
            hub = least.where("a < b").select(F.col("a").alias("hub"))
            leaf = least.where("b < a").select("a", F.col("b").alias("hub")).join(hub, "hub")
            star = leaf.select("hub", F.col("a").alias("ent")).unionByName(leaf.select("hub", F.col("hub").alias("ent")).distinct())
            laid = star.join(prof, "ent").select(F.col("hub").cast("string").alias("key"), F.lit(0).alias("part"), "ent", "vs")
            return shared_checkpoint(laid.repartition(parts, "key").sortWithinPartitions("key", "ent").mapInPandas(blocks, "a bigint, b bigint").distinct())
        fits = shared_checkpoint(crossed(hot, "fits").groupBy("key", "a").agg(F.count_distinct("b").alias("n"), F.min("b").alias("b")))
        loose = hot.where("not whole").join(fits.select("key", F.col("a").alias("ent")), ["key", "ent"], "left_anti")
        near_loose = crossed(loose, "loose").groupBy("key", "a").agg(F.min("b").alias("b"))
        return shared_checkpoint(fits.where("n = 1").select("a", "b").unionByName(near_loose.select("a", "b")).distinct())

    turn, fresh = 0, None
    k = shared_checkpoint(prof.mapInPandas(keyed, "key string, ent bigint, whole boolean"))
    while True:
        size = shared_checkpoint(k.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("ent").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("ent", F.lit(1))).alias("x")).where("n > 1"))
        # After the first round only blocks with a merged profile can show anything new.
        open_ = size if fresh is None else size.join(fresh.select("key").distinct(), "key", "left_semi")
        # A block beyond BLOCK profiles is dealt out; what its parts merge meets again in the next round. A
        # round without links ends it only after all pairs of parts have met.
        chosen = once(open_).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).select("key", "parts")
        dealt = k.join(chosen, "key").where("whole or parts = 1").withColumn("part", F.pmod(F.xxhash64("ent", F.lit(turn)), F.col("parts")))
        laid = dealt.join(prof, "ent").select("key", "part", "ent", "vs").repartition(parts, "key", "part").sortWithinPartitions("key", "part", "ent")
        links = shared_checkpoint(laid.mapInPandas(blocks, "a bigint, b bigint").distinct())
        if links.limit(1).count() == 0:
            links = missed(k, size)
        if links is None or links.limit(1).count() == 0:
            return owner.select("name", F.col("ent").alias("entity_id"))
        root = components(links).select(F.col("node").alias("ent"), "root")
        up = prof.join(root, "ent").select(F.col("root").alias("ent"), "vs")
        merged = shared_checkpoint(up.groupBy("ent").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("vs")))
        prof = shared_checkpoint(prof.join(root.select("ent"), "ent", "left_anti").unionByName(merged))
        owner = shared_checkpoint(owner.join(root, "ent", "left").select("name", F.coalesce("root", "ent").alias("ent")))
        fresh = shared_checkpoint(merged.mapInPandas(keyed, "key string, ent bigint, whole boolean"))
        k = shared_checkpoint(k.join(root.select("ent"), "ent", "left_anti").select("key", "ent", "whole").unionByName(fresh))
        turn += 1


def name_pairs(resolved: DataFrame, most: int = 2000) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of the different strings of each entity. An entity of more than ``most``
    strings is split: each part of its first side meets all of the second, so no task holds all its pairs."""
    parts = resolved.groupBy("entity_id").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    r = resolved.join(parts, "entity_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = r.select("entity_id", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = r.select("entity_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("name_b"))
    return a.join(b, ["entity_id", "part"]).where("name_a < name_b").select("name_a", "name_b")

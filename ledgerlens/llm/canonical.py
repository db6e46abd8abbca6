"""Free-typed names mapped to the entries of a reference list.

An Aho-Corasick automaton over the list's names and their aliases finds embedded mentions; the longest
non-overlapping matches win. A name that its mentions don't explain goes to token-set similarity with
typing errors and abbreviations allowed. Names outside the list that never stand beside an entry are learned
as its aliases. What stays below the threshold is reported as unmatched (0).

Defined results: a null name gives no row in name_mappings; an empty or sign-only name is unmatched; an
empty list leaves every name unmatched; equal names get equal entries. A tie between entries goes to the
smaller id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, broadcast_if_small, shared_checkpoint, spread

# Other names of accounts in common accounting usage (textbook synonyms and abbreviations).
ALIASES = {
    "Cash at bank and on hand": ["bank balances", "liquid funds", "cash and cash equivalents", "cash and bank", "cash in hand", "cash"],
    "Trade receivables": ["debtors", "accounts receivable"],
    "Inventories": ["stock on hand", "inventory", "stocks", "stock in trade", "merchandise"],
    "Prepayments and advances": ["prepaid expenses", "prepayments"],
    "Contract assets": ["unbilled revenue", "accrued revenue"],
    "Land and buildings": ["real estate", "property"],
    "Plant and machinery": ["machinery", "equipment"],
    "Right-of-use assets": ["rou", "leased assets", "rou assets", "assets under lease"],
    "Purchased goodwill": ["acquired goodwill", "goodwill"],
    "Development costs capitalised": ["capitalised r&d", "capitalised development", "capitalized development costs", "capitalised r d"],
    "Deferred tax asset": ["dta", "future tax benefit"],
    "Total assets": ["balance sheet total"],
    "Trade payables": ["creditors", "accounts payable", "due to suppliers"],
    "Bank overdrafts": ["overdraft", "bank overdraft"],
    "Accrued expenses payable": ["accruals", "accrued liabilities", "accrued costs"],
    "Contract liabilities": ["customer deposits", "deferred revenue"],
    "Current tax payable": ["income tax payable", "current tax liability"],
    "Long-term borrowings": ["lt debt", "long term debt", "long term loans", "non current borrowings"],
    "Lease liabilities": ["obligations under leases", "lease obligations"],
    "Retirement benefit obligations": ["pension deficit", "pension obligations", "pension liability", "post employment benefits"],
    "Deferred tax liability": ["dtl", "future tax liability"],
    "Provisions for restoration": ["asset retirement obligation", "restoration provision"],
    "Share capital": ["issued capital", "common stock", "paid in capital", "capital stock"],
    "Share premium": ["capital in excess of par", "additional paid in capital", "apic", "premium on shares"],
    "Retained earnings": ["accumulated profits", "profit carried forward"],
    "Own shares held": ["treasury stock", "treasury shares", "own shares"],
    "Minority interests": ["non controlling interests", "nci", "noncontrolling interests"],
    "Total equity": ["net worth", "shareholders funds", "shareholders equity", "owners equity"],
    "Shares in issue": ["shares outstanding", "number of shares in issue"],
    "Investment property area": ["rentable area"],
    "Revenue from contracts": ["turnover", "net sales", "sales", "revenue", "revenues", "top line"],
    "Other operating income": ["sundry income", "other income", "miscellaneous income"],
    "Cost of sales": ["cogs", "direct costs", "cost of goods sold", "cost of revenue"],
    "Staff costs": ["payroll", "wages and salaries", "personnel expenses", "employee costs"],
    "Marketing and distribution costs": ["selling expenses", "sales and marketing", "distribution expenses"],
    "Administrative expenses": ["overheads", "g&a", "g a", "general and administrative", "admin costs"],
    "Research expenditure": ["r&d", "r d", "research and development", "research costs"],
    "Depreciation and amortisation": ["d&a", "d a", "depreciation"],
    "Operating profit": ["ebit", "result from operations", "operating income", "operating result"],
    "Finance income": ["interest received", "interest income", "financial income"],
    "Finance costs": ["interest expense", "interest costs", "financial expenses"],
    "Profit before tax": ["pbt", "pre tax result", "pretax profit", "earnings before tax", "ebt", "pre tax profit"],
    "Income tax charge": ["taxation", "tax expense", "income tax expense", "tax charge"],
    "Profit for the period": ["net income", "bottom line", "net profit", "profit for the year", "net result"],
    "Basic earnings per share": ["eps", "basic eps", "earnings per share"],
    "Weighted average share count": ["wasc", "average number of shares", "average shares outstanding", "weighted average shares"],
    "Operating margin": ["ebit to sales", "return on sales", "ebit margin"],
    "Effective tax rate": ["etr", "tax rate"],
    "Energy consumed": ["energy use", "energy consumption"],
    "Share-based payment expense": ["stock comp", "stock based compensation", "share options charge", "stock compensation"],
    "Working capital movement": ["change in working capital", "movement in working capital"],
    "Income taxes paid": ["taxes paid", "cash taxes", "tax paid"],
    "Cash generated from operations": ["cfo", "operating cash flow", "cash from operations"],
    "Purchase of fixed assets": ["capex", "additions to ppe", "capital expenditure", "capital expenditures", "additions to pp&e"],
    "Acquisition of subsidiaries": ["business combinations", "purchase of businesses"],
    "Proceeds from disposals": ["sale of assets", "disposal proceeds"],
    "Cash used in investing": ["cfi", "investing cash flow"],
    "New loans drawn": ["proceeds from loans"],
    "Repayment of borrowings": ["repayment of loans"],
    "Dividends distributed": ["dividends paid", "distributions to owners"],
    "Cash from financing": ["cff", "financing cash flow"],
    "Exchange differences on cash": ["fx effect", "fx effects", "effect of exchange rates"],
    "Net movement in cash": ["net change in cash", "change in cash"],
    "Opening cash balance": ["cash b/f", "cash b f", "cash brought forward", "opening cash"],
    "Closing cash balance": ["cash c/f", "cash c f", "cash carried forward", "closing cash"],
    "Cash conversion rate": ["cash conversion"],
}
# Abbreviations of words in account names.
SHORT = {
    "acc": ["accrued"], "acq": ["acquisition"], "admin": ["administrative"], "amort": ["amortisation"], "ast": ["asset", "assets"], "assts": ["assets"],
    "avg": ["average"], "bal": ["balance"], "bldgs": ["buildings"], "borr": ["borrowings"], "cap": ["capital"], "chg": ["charge"], "ctrs": ["contracts"], "contr": ["contract"],
    "curr": ["current"], "def": ["deferred"], "depr": ["depreciation"], "dep": ["depreciation"], "dev": ["development"], "distr": ["distribution"], "div": ["dividends"],
    "earn": ["earnings"], "equip": ["equipment"], "exch": ["exchange"], "exp": ["expenses", "expense", "expenditure"], "fin": ["financing", "finance"], "gen": ["generated"],
    "inc": ["income"], "interests": ["interests"], "inv": ["investing", "investment"], "invent": ["inventories"], "liab": ["liability", "liabilities"], "lt": ["long", "term"],
    "mach": ["machinery"], "min": ["minority"], "mkt": ["marketing"], "mvmt": ["movement"], "oblig": ["obligations"], "op": ["operating"], "ops": ["operations"], "pmt": ["payment"],
    "prd": ["period"], "prem": ["premium"], "prepmts": ["prepayments"], "proc": ["proceeds"], "prop": ["property"], "prov": ["provisions"], "purch": ["purchase", "purchased"],
    "pybl": ["payables", "payable"], "recv": ["receivables"], "rec": ["receivables"], "res": ["research"], "ret": ["retirement", "retained"], "rev": ["revenue"], "tot": ["total"],
    "wt": ["weight"], "wtd": ["weighted"], "cost": ["costs", "cost"], "costs": ["costs", "cost"], "cash": ["cash"],
}
NOISE = frozenset("less net note of the and on at in for from by to a an".split())
DROPPED = frozenset("less net note".split())
AT_LEAST = 0.84
MOST_ENTRIES = 200_000
#: Distinct names that may travel with every task; beyond that they are joined by a shuffle.
SMALL_NAMES = 500_000
SEP = "\x1f"


def words_of(name: str) -> list[str]:
    """Words in lower case, without numbering, years, note references and trailing marks."""
    t = unicodedata.normalize("NFKC", name)
    t = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", t).lower()
    t = re.sub(r"\(?\bnotes?\s*\d+[a-z]?\)?", " ", t)
    t = re.sub(r"[’']", "", t).replace("&", " & ").replace("/", " / ")
    words = re.findall(r"[^\W\d_]+|&|/", t)
    return [w for w in words if w not in "&/"]


def edits(a: str, b: str, most: int) -> int:
    """Optimal-string-alignment distance (a swap of neighbours counts one), most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return prev[-1]


class CanonicalMapper:
    """The mapper of one list; ``entries`` are (id, group, canonical name)."""

    def __init__(self, entries: list[tuple[int, str, str]], aliases: dict[str, list[str]] | None = None, at_least: float = AT_LEAST):
        import ahocorasick

        aliases = aliases or {}
        self.at_least = at_least
        self.auto: dict[str, object] = {}
        self.words: dict[str, dict[str, set[str]]] = {}
        self.holding: dict[str, dict[str, list[int]]] = {}
        self.names: dict[str, list[tuple[int, list[str], str]]] = {}
        for gid in {g for _, g, _ in entries}:
            auto = ahocorasick.Automaton()
            pats: dict[str, tuple[int, int]] = {}
            own = sorted((i, n) for i, g, n in entries if g == gid and n)
            for i, n in own:
                for rank, text in [(0, n), *((1, a) for a in aliases.get(n, []))]:
                    w = words_of(text)
                    key = SEP + SEP.join(w) + SEP
                    if w and (key not in pats or pats[key][0] > rank):
                        pats[key] = (rank, i)
            for key, (_, i) in pats.items():
                auto.add_word(key, (i, len(key)))
            if pats:
                auto.make_automaton()
                self.auto[gid] = auto
            self.words[gid] = {w: set(w) for _, n in own for x in [n, *aliases.get(n, [])] for w in words_of(x)}
            self.names[gid] = [(i, [w for w in words_of(x)], "".join(words_of(x))) for i, n in own for x in [n, *aliases.get(n, [])]]
        for gid, names in self.names.items():
            held = self.holding.setdefault(gid, {})
            for e, (_, own, _) in enumerate(names):
                for w in dict.fromkeys(own):
                    held.setdefault(w, []).append(e)
        self.map = lru_cache(maxsize=200_000)(self._map)
        self.alike_words = lru_cache(maxsize=300_000)(self.alike)

    def mentions(self, group: str, words: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, id) of the longest non-overlapping mentions, in characters of the joined words."""
        auto = self.auto.get(group)
        if auto is None or not words:
            return []
        text = SEP + SEP.join(words) + SEP
        hits = sorted(((e + 1 - ln, e + 1, i) for e, (i, ln) in auto.iter(text)), key=lambda h: (-(h[1] - h[0]), h[0]))
        taken: list[tuple[int, int, int]] = []
        for s, e, i in hits:
            if all(e <= a + 1 or s >= b - 1 for a, b, _ in taken):
                taken.append((s, e, i))
        return sorted(taken)

    def _map(self, group: str, name: str) -> tuple[int, str, float]:
        words = words_of(name)
        content = [w for w in words if w not in DROPPED] or words
        if not content or group not in self.names:
            return 0, "none", 0.0
        found = self.mentions(group, words)
        ids = {i for *_, i in found}
        if len(ids) == 1:
            text = SEP + SEP.join(words) + SEP
            rest = text
            for s, e, _ in found:
                rest = rest[: s + 1] + " " * (e - s - 2) + rest[e - 1 :]
            left = [w for w in rest.replace(" ", "").split(SEP) if w and w not in NOISE]
            if not left:
                return ids.pop(), "mention", 1.0
        best = self.similar(group, content)
        return (best[0], "token_set", best[1]) if best[1] >= self.at_least else (0, "none", best[1])

    @staticmethod
    def _word_like(a: str, b: str) -> float:
        """Likeness of two words: equal, an abbreviation, or few edits."""
        if a == b:
            return 1.0
        if b in SHORT.get(a, ()) or a in SHORT.get(b, ()):
            return 0.97
        n = max(len(a), len(b))
        most = 0 if n < 4 else 1 if n < 6 else 2 if n < 10 else 3
        d = edits(a, b, most)
        return 1 - 0.6 * d / n if d <= most else 0.0

    def alike(self, group: str, word: str) -> tuple[tuple[str, float], ...]:
        """The words of a group's names that ``word`` can stand for, with their likeness."""
        n, letters, out = len(word), set(word), []
        for v, own in self.words[group].items():
            long = max(n, len(v))
            most = 0 if long < 4 else 1 if long < 6 else 2 if long < 10 else 3
            short = v in SHORT.get(word, ()) or word in SHORT.get(v, ())
            if v == word or short or (abs(n - len(v)) <= most and len(letters ^ own) <= 2 * most):
                s = self._word_like(word, v)
                if s > 0.5:
                    out.append((v, s))
        return tuple(out)

    def similar(self, group: str, words: list[str]) -> tuple[int, float]:
        """The entry whose token set is most like the words', by summed weight of paired words. Only entries
        that share an alike word are scored; the others' likeness is 0."""
        like = {w: dict(self.alike_words(group, w)) for w in dict.fromkeys(words)}
        touched = sorted({e for m in like.values() for v in m for e in self.holding[group].get(v, ())})
        best, at = 0.0, 0
        for e in touched:
            i, own, _ = self.names[group][e]
            score = self.token_set(words, own, like)
            if score > best + 1e-12:
                best, at = score, i
        joined = "".join(words)
        if best < self.at_least and len(joined) >= 6:  # written together or with blanks astray
            for i, _, squashed in self.names[group]:
                n = max(len(joined), len(squashed))
                most = max(1, n // 7)
                if abs(len(joined) - len(squashed)) <= most and len(set(joined) ^ set(squashed)) <= 2 * most:
                    d = edits(joined, squashed, most)
                    if d <= most and 1 - 0.6 * d / n > best + 1e-12:
                        best, at = 1 - 0.6 * d / n, i
        return at, best

    @staticmethod
    def token_set(a: list[str], b: list[str], like: dict[str, dict[str, float]]) -> float:
        """Weighted share of the two sets' words that pair up; words match at most once."""
        wa = [(w, 0.2 if w in NOISE else 1.0) for w in dict.fromkeys(a)]
        wb = [(w, 0.2 if w in NOISE else 1.0) for w in dict.fromkeys(b)]
        pairs = sorted(((like[x][y], i, j) for i, (x, _) in enumerate(wa) for j, (y, _) in enumerate(wb) if y in like[x]), key=lambda p: (-p[0], p[1], p[2]))
        ua, ub, got = set(), set(), 0.0
        for s, i, j in pairs:
            if i not in ua and j not in ub:
                ua.add(i)
                ub.add(j)
                got += s * (wa[i][1] + wb[j][1])
        total = sum(w for _, w in wa) + sum(w for _, w in wb)
        return got / total if total else 0.0


def learn_aliases(seen: DataFrame, most_chance: float = 0.05) -> DataFrame:
    """(g, key, learned): names outside the list that stand for an entry, told by what they stand beside.

    ``seen`` (g, case, key, id): the names of each case (a statement), by their words, with the entry found or 0. A
    case names an entry once; so an unknown name that stands in many cases, but never beside an entry which cases of
    its group often have, is another name of that entry. The evidence is the log-likelihood ratio of the few common
    cases against the entry's share of all cases; it must be beyond chance over all names and entries tried
    (``most_chance``), and the entry must be the only one of its name. Counts cover all cases; names are compared only
    with entries of at least a twentieth of the group's cases, which number at most twenty times the names a case has.
    """
    cases = seen.groupBy("g").agg(F.count_distinct("case").alias("n_cases"))
    have = seen.where("id > 0").select("g", "case", "id").distinct()
    share = have.groupBy("g", "id").agg(F.count("*").alias("k")).join(cases, "g").select("g", "id", (F.col("k") / F.col("n_cases")).alias("p")).where("p >= 0.05 and p < 1")
    unknown = seen.where("id = 0 and key <> ''").select("g", "case", "key").distinct()
    often = unknown.groupBy("g", "key").agg(F.count("*").alias("n")).where("n >= 5")
    beside = unknown.join(often.select("g", "key"), ["g", "key"], "left_semi").join(have, ["g", "case"]).groupBy("g", "key", "id").agg(F.count("*").alias("c"))
    pairs = often.join(share, "g").join(beside, ["g", "key", "id"], "left").withColumn("q", F.coalesce("c", F.lit(0)) / F.col("n"))
    tried = pairs.agg(F.log(F.count("*") / F.lit(most_chance)).alias("limit"))
    q, pr = F.greatest("q", F.lit(1e-9)), F.col("p")
    llr = F.col("n") * (q * F.log(q / pr) + (1 - q) * F.log((1 - q) / (1 - pr)))
    fit = pairs.where("q < 0.1 * p").withColumn("llr", llr).join(F.broadcast(tried)).where("llr >= limit")
    return fit.groupBy("g", "key").agg(F.max_by("id", "llr").alias("learned"), F.count("*").alias("m")).where("m = 1").select("g", "key", "learned")


def map_names(items: DataFrame, entries: DataFrame, group: str, name: str, list_group: str, list_id: str, list_name: str, keep: list[str], aliases: DataFrame | None = None, within: str | None = None, at_least: float = AT_LEAST) -> DataFrame:
    """Rows of ``items`` (columns ``keep``, group, name) with canonical_id (0: unmatched), match_kind, score.

    ``aliases`` (name, alias) are other names of entries; ``within`` names a column whose rows belong together, by
    which further aliases are learned (see ``learn_aliases``). The list and the aliases are stated and checked in
    size. Each distinct name is mapped once and joined back; items themselves are not shuffled while the distinct
    names are few enough to travel.
    """
    rows = bounded_rows(entries.select(F.col(list_id).cast("int").alias("i"), F.col(list_group).cast("string").alias("g"), F.col(list_name).alias("n")).where("i is not null and g is not null and n is not null").distinct(), MOST_ENTRIES, "reference list")
    listed = [(r["i"], r["g"], r["n"]) for r in rows]
    others: dict[str, list[str]] = {}
    for r in bounded_rows(aliases.select("name", "alias").where("name is not null and alias is not null").distinct(), MOST_ENTRIES, "aliases") if aliases is not None else []:
        others.setdefault(r["name"], []).append(r["alias"])
    src = items.select(*dict.fromkeys([*keep, group, name]))
    typed = items.where(F.col(name).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(name).alias("n"), *([F.col(within).alias("case")] if within else []))

    def mapping(known: dict[str, list[str]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mapper = CanonicalMapper(listed, {k: sorted(v) for k, v in known.items()}, at_least)
            for b in batches:
                got = [mapper.map(g, n) for g, n in zip(b["g"], b["n"])]
                yield pd.DataFrame({"g": b["g"], "n": b["n"], "key": [" ".join(words_of(n)) for n in b["n"]], "id": [x[0] for x in got], "match_kind": [x[1] for x in got], "score": [x[2] for x in got]}).astype({"id": "int32", "score": "float64"})

        return run

    schema = "g string, n string, key string, id int, match_kind string, score double"
    mapped = shared_checkpoint(spread(typed.select("g", "n").distinct()).mapInPandas(mapping(others), schema))
    if within:
        seen = typed.where("case is not null").distinct().join(broadcast_if_small(mapped.select("g", "n", "key", "id"), SMALL_NAMES), ["g", "n"])
        called = {i: n for i, _, n in listed}
        more = {k: list(v) for k, v in others.items()}
        for r in bounded_rows(learn_aliases(seen.select("g", "case", "key", "id")), MOST_ENTRIES, "learned aliases"):
            more.setdefault(called[r["learned"]], []).append(r["key"])
        # What had no entry is mapped again, now that more aliases are known, with its errors of typing.
        again = mapped.where("id = 0").select("g", "n").mapInPandas(mapping(more), schema).withColumn("match_kind", F.when(F.col("id") > 0, "learned").otherwise("none"))
        mapped = shared_checkpoint(mapped.where("id > 0").unionByName(again))
    found = mapped.select(F.col("g").alias("__g"), F.col("n").alias("__n"), "id", F.col("match_kind").alias("__kind"), F.col("score").alias("__score"))
    j = src.join(broadcast_if_small(found, SMALL_NAMES), (F.col(group).cast("string") == F.col("__g")) & (F.col(name) == F.col("__n")), "left")
    own = [F.col(c) for c in src.columns if c not in ("canonical_id", "match_kind", "score")]
    return j.select(*own, F.when(F.col(name).isNotNull(), F.coalesce("id", F.lit(0))).cast("int").alias("canonical_id"), F.coalesce("__kind", F.lit("none")).alias("match_kind"), F.coalesce("__score", F.lit(0.0)).alias("score"))


def accounting_aliases(spark: SparkSession) -> DataFrame:
    """The aliases of ALIASES as a table (name, alias)."""
    return spark.createDataFrame([(n, a) for n, xs in ALIASES.items() for a in xs], "name string, alias string")


def account_mappings(items: DataFrame, accounts: DataFrame) -> DataFrame:
    """item_id, account_id of each item whose name is not letter for letter an account of its statement."""
    listed = accounts.select(F.col("statement").alias("statement_type"), F.col("account").alias("name")).where("name is not null").distinct()
    own = items.where(F.col("name").isNotNull()).select("item_id", "statement_id", "statement_type", "name")
    m = map_names(own, accounts, "statement_type", "name", "statement", "account_id", "account", ["item_id"], accounting_aliases(items.sparkSession), "statement_id")
    other = m.join(broadcast_if_small(listed, MOST_ENTRIES), ["statement_type", "name"], "left_anti")
    return other.select("item_id", F.col("canonical_id").alias("account_id")).distinct()

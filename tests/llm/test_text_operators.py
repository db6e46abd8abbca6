import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import canonical, entities, leakage, mixing, ocr, pii, pii_train, sentences


# Personal information -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def held_out():
    return pii_train.made_texts(250, 77)


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

def test_pii_held_out_accuracy(held_out):
    acc = pii_train.accuracy(pii.load_weights(), held_out)
    assert all(p > 0.9 and r > 0.9 for p, r in acc.values()), acc


def test_pii_training_beats_no_training(held_out):
    w = pii_train.fit(pii_train.made_texts(250, 3), epochs=2)
    acc = pii_train.accuracy(w, held_out)
    assert sum(r for _, r in acc.values()) / 5 > 0.8
    assert all(r == 0 for _, r in pii_train.accuracy({}, held_out[:20]).values())


def test_pii_decoding_is_the_best_segmentation():
    crf = pii.SemiCrf({"person_name:bias": 1.0, "phone:bias": 0.5})
    d = pii.Doc("Mary Oakwick rang +44 20 7946 0241 today", {"rang", "today"})
    arcs = [(a, b, crf.score(f)) for a, b, _, f in crf.arcs(d)]

    def best(at):
        if at >= d.n:
            return 0.0
        return max([best(at + 1)] + [s + best(b) for a, b, s in arcs if a == at and s > 0])

    got = sum(max(s for a, b, s in arcs if (a, b) == (x, y)) for x, y, _ in crf.decode(d))
    assert got == pytest.approx(best(0))


def test_pii_spans_and_redaction():
    f = pii.PiiFinder({"the", "of", "can", "be", "reached", "on", "after", "closing", "and", "limits", "dividends", "act", "sold", "mill"})
    t = "Mr Anthony Oakmere of the trustee can be reached on +44 (0)1632 960295 after closing. The Oakmere Act of 2019 limits dividends."
    assert [(y, t[a:b]) for a, b, y in f.find(t)] == [("person_name", "Anthony Oakmere"), ("phone", "+44 (0)1632 960295")]
    assert f.redact("mailto:mary.oakwick@velmar.example?subject=q1") == "mailto:[EMAIL]?subject=q1"
    assert f.find("") == [] and f.redact("plain text") == "plain text" and f.find("x " * 20000) == []


def test_pii_tables(spark):
    d = spark.createDataFrame([("1", "Contact: mary.oakwick@velmar.example"), ("2", None), ("3", ""), ("1", "Contact: mary.oakwick@velmar.example")], "rec_id string, text string").withColumn("mention", F.lit("clash"))
    assert [(r["rec_id"], r["start_char"], r["end_char"]) for r in pii.find_pii(d, ["rec_id"]).distinct().collect()] == [("1", 9, 36)]
    r = {x["rec_id"]: x["redacted"] for x in pii.redact_pii(d).collect()}
    assert r == {"1": "Contact: [EMAIL]", "2": None, "3": ""}
    assert pii.find_pii(d.limit(0), ["rec_id"]).count() == 0


# Scanned pages --------------------------------------------------------------------------------------

def brute(word, most, vocab):
    def d(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    return sorted((v, d(word, v), n) for v, n in vocab.items() if d(word, v) <= most)


def test_automaton_finds_every_candidate():
    r = random.Random(4)
    vocab = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))): r.randint(1, 9) for _ in range(200)}
    trie = ocr.Trie(vocab)
    for w in ["abc", "aabbcc", "zz", "a", "cabcab"]:
        for k in (0, 1, 2, 3):
            assert sorted(ocr.LevenshteinAutomaton(w, k).within(trie)) == brute(w, k, vocab)
            assert sorted(ocr.LevenshteinAutomaton(w, k).within(trie, 5)) == [x for x in brute(w, k, vocab) if x[2] >= 5]


SCAN = "The selling sharehold-\ners signed off on the\nlease register, m0stly\nbecause of staff turno-\nver in the ledger tearn.\n— 85 —\nVelmar Group - Annual Review 2017\n\nRevenue moved by l4.35%\npoints after the change\nin rebate terms. It was\n"


def repairer():
    words = "the selling shareholders signed off on lease register mostly because of staff turnover in ledger team revenue moved by points after change rebate terms it was annual review group quality-of-earnings".split()
    return ocr.Repairer({w: 500 for w in words}, {}, {"X group - annual review 9"})


def test_scan_repair():
    f, fixed = repairer().findings(SCAN)
    assert f == [(0, "hyphen", "shareholders"), (2, "char", "mostly"), (3, "hyphen", "turnover"), (4, "char", "team"), (5, "page_number", ""), (6, "header", ""), (8, "char", "14.35")]
    assert fixed == "The selling shareholders signed off on the lease register, mostly because of staff turnover in the ledger team.\n\nRevenue moved by 14.35% points after the change in rebate terms. It was"


def test_two_confusions_of_several_letters_are_found():
    rep = ocr.Repairer({w: 20000 for w in ("statement", "commission", "drawdown", "office", "affluent", "modern")}, {}, set())
    for read, printed in (("staternemt", None), ("stalernent", "statement"), ("cornrnission", "commission"), ("clrawclown", "drawdown"), ("oﬃce", "office"), ("Oﬃee", "Office"), ("aﬄuent", "affluent"), ("rnoclern", "modern")):
        assert rep.fix(read, "", "") == printed


def test_misread_equals_brute_force():
    r = random.Random(8)
    bits = ["rn", "m", "cl", "d", "ii", "u", "li", "h", "vv", "w", "ffi", "e", "c", "o"]
    vocab = {"".join(r.choice(bits) for _ in range(r.randint(1, 4))): r.randint(1, 9) for _ in range(400)}
    trie = ocr.Trie(vocab)
    for _ in range(150):
        read = "".join(r.choice(bits + ["ﬃ"]) for _ in range(r.randint(1, 4)))
        for least in (0, 5):
            want = {v: (k, n) for v, n in vocab.items() if n >= least and (k := ocr.explained(read, v)) is not None}
            assert {v: x[:2] for v, x in ocr.misread(read, trie, least).items()} == want


def test_neighbours_decide_among_all_candidates():
    swap = {a: [b for x, b in ocr.CONFUSIONS if x == a and len(b) == 1] for a, _ in ocr.CONFUSIONS if len(a) == 1}
    read = "oelatolifah"
    one = {read[:i] + b + read[i + 1 :] for i in range(len(read)) for b in swap.get(read[i], [])}
    two = {v[:i] + b + v[i + 1 :] for v in one for i in range(len(v)) for b in swap.get(read[i], []) if v[i] == read[i]}
    words = sorted((one | two) - {read})
    right = max(two - one)
    rep = ocr.Repairer({w: 900 if w == right else 1000 for w in words}, {("the", right): 10**6}, set())
    assert len(words) > 50 and [v for v, _ in rep.candidates(read)].index(right) >= 50
    assert rep.fix(read, "the", "") == right


def test_other_texts_stay():
    r = repairer()
    table = "Statement of cash\n2021\n2020\nRevenue                 4,924      39,239\nCosts                   1,111      22,222"
    assert r.findings(table) == ([], table) and r.findings("") == ([], "") and r.join("quality", "of-earnings", "-") == "quality-of-earnings"


def test_scan_tables(spark):
    d = spark.createDataFrame([("a", SCAN)] * 2 + [("b", None), ("c", "")], "chunk_id string, content string")
    r = {x["chunk_id"]: x for x in ocr.repair_scans(d).collect()}
    assert len(r) == 3 and r["b"]["repaired"] is None and r["c"]["findings"] == []
    assert (5, "page_number", "") in [tuple(x) for x in r["a"]["findings"]]
    assert ocr.repair_scans(d.limit(0)).count() == 0


# Canonical names ------------------------------------------------------------------------------------

LIST = [(1, "b", "Cash at bank and on hand"), (2, "b", "Trade receivables"), (3, "b", "Total assets"), (4, "c", "Income taxes paid"), (5, "b", "Deferred tax asset")]


@pytest.mark.parametrize("group,name,want", [("b", "TRADE RECEIVABLES, net", 2), ("b", "Receivables, trade (Note 7)", 2), ("b", "3.7 debtors", 2), ("b", "Totl asets 2019", 3), ("b", "TradeReceivables", 2), ("b", "tot. ast", 3), ("c", "Trade receivables", 0), ("b", "tax", 0), ("b", "", 0), ("b", "!!", 0), ("c", "cash taxes", 4), ("b", "Hedging reserve", 0), ("x", "Total assets", 0)])
def test_mapping(group, name, want):
    assert canonical.CanonicalMapper(LIST, canonical.ALIASES).map(group, name)[0] == want


def test_mentions_are_the_longest_that_do_not_overlap():
    m = canonical.CanonicalMapper([(1, "g", "Tax"), (2, "g", "Tax asset"), (3, "g", "Deferred tax")], {})
    assert [i for *_, i in m.mentions("g", ["deferred", "tax", "asset"])] in ([3], [3, 1], [3])
    assert [i for *_, i in m.mentions("g", ["tax", "asset", "tax"])] == [2, 1]


def test_mapping_tables(spark):
    acc = spark.createDataFrame(LIST, "account_id int, statement string, account string")
    li = spark.createDataFrame([(1, "b", "Trade receivables"), (2, "b", "debtors"), (2, "b", "debtors"), (3, "b", None), (4, None, "x"), (5, "b", "y" * 50000)], "item_id bigint, statement_type string, name string").withColumn("account_id", F.lit("clash")).withColumn("statement_id", F.lit("s"))
    assert {tuple(r) for r in canonical.account_mappings(li, acc).collect()} == {(2, 2), (4, 0), (5, 0)}
    assert canonical.account_mappings(li, acc.limit(0)).where("account_id <> 0").count() == 0 and canonical.account_mappings(li.limit(0), acc).count() == 0


# Names of entities ----------------------------------------------------------------------------------

SAME = [["Brencol Gumun Construction S.A.", "BRENCOL GUMUN CONSTR. S.A.", "Gumun Brencol Construction S.A.", "Brencol G. Construction SA", "BrencolGumun Construction", "The Brenccol Gumun Construction S. A."], ["Brencol Gumun Energy S.A."], ["Zirlas Gompan Properties II Limited", "Zirlas-Gompan Props II Ltd."], ["Zirlas Gompan Properties III Limited"], ["Michael Kammar t/a Glora Joinery", "Kammar, Mike t/a Glora Joinery", "Glora Joinery (M. Kammar)", "Mike Kammar Glora Jnry", "Kammar Mike"], ["Susan Kammar t/a Borri Bakery"]]


def test_entities_are_linked(spark):
    names = [n for g in SAME for n in g]
    d = spark.createDataFrame([(n,) for n in names * 2] + [(None,), ("",), ("--",)], "name string")
    r = entities.resolve_names(d).collect()
    by = {}
    for x in r:
        by.setdefault(x["entity_id"], set()).add(x["name"])
    assert {frozenset(v) for v in by.values() if "Gumun" in str(v) or "Zirlas" in str(v) or "Kammar" in str(v) or "KAMMAR" in str(v)} == {frozenset(g) for g in SAME}
    pairs = {tuple(x) for x in entities.name_pairs(entities.resolve_names(d)).collect()}
    assert pairs == {(a, b) for g in SAME for a in g for b in g if a < b}
    assert entities.resolve_names(d.limit(0)).count() == 0


def test_hot_blocks_are_split_and_meet_again(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 3)
    names = ["Brencol Gumun Construction S.A."] + [f"Brencol Gumun Construction S.A.{' ' * k}" for k in range(1, 4)] + [f"Brencol Gumun {x}" for x in ("Constr. SA", "Construction", "CONSTR.", "Construction SA", "Constr S.A.")] + [f"Brenc{c}l Gumun Construction S.A." for c in "aeiu"]
    r = entities.resolve_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len({x["entity_id"] for x in r}) == 1


def test_result_does_not_depend_on_block_size(spark, monkeypatch):
    r = random.Random(3)
    given = {"James": "Jim", "Helen": "Nell", "Victor": "Vic", "Walter": "Walt", "Pamela": "Pam", "Gregory": "Greg", "Sarah": "Sally", "Dorothy": "Dot"}
    trades = [f"{a}{b}" for a in ("Glo", "Bor", "Zim", "Tav") for b in ("ra", "ri", "xel", "mund")]
    one = [f"{g} Kammar t/a {t} {w}" for g in given for t, w in zip(trades, ("Joinery", "Bakery", "Florist", "Salon") * 4)]
    names = one + [f"{given[n.split()[0]]} {n.split(' ', 1)[1]}" for n in r.sample(one, 12)] + ["James Kammar", "Kammar Helen", "Sally Kammar", "Greg Kammar", "Henry Kammar", "Harry Kammar"]
    found = []
    for most in (3, 10_000):
        monkeypatch.setattr(entities, "BLOCK", most)
        by = {}
        for x in entities.resolve_names(spark.createDataFrame([(n,) for n in names], "name string")).collect():
            by.setdefault(x["entity_id"], set()).add(x["name"])
        found.append({frozenset(v) for v in by.values()})
    assert found[0] == found[1] and len(found[0]) == len(one) + 5
    assert {"James Kammar"} in found[0] and {"Henry Kammar", "Harry Kammar"} in found[0]


def test_ambiguous_name_stays_alone():
    rows = [(k, [entities.parse(n)]) for k, n in enumerate(["Ab Cdef Energy S.A.".replace("Ab", "Abcde"), "Abcde Cdef Foods S.A.", "Abcde Cdef S.A."])]
    assert entities.merge_block(rows) == []


# Leaks ----------------------------------------------------------------------------------------------

def leak_case():
    r = random.Random(9)
    words = ["w%d" % k for k in range(400)]
    items = [(k, " ".join(r.choice(words) for _ in range(70))) for k in range(12)]
    docs, want = [], set()
    for k, (i, t) in enumerate(items):
        w = t.split()
        for share, change, two in ((1.0, 0, False), (0.5, 3, False), (0.5, 2, True), (0.25, 0, False)):
            n = int(70 * share)
            part = w[5 : 5 + n] if share < 1 else list(w)
            for p in r.sample(range(1, len(part) - 1), change):
                part[p] = "other"
            fill = [r.choice(words) + "x" for _ in range(60)]
            text = fill + part + fill if not two else part[: n // 2] + fill + part[n // 2 :]
            docs.append((len(docs), " ".join(text).upper().replace(" W1", ",\n  w1")))
            if share > 0.4:
                want.add((len(docs) - 1, i))
    return items, docs, want


def test_leaks_equal_brute_force(spark):
    items, docs, want = leak_case()
    memo = {}
    brute = {(d, i) for d, t in docs for i, x in items if leakage.coverage(leakage.symbols(leakage.words_of(x), memo), leakage.symbols(leakage.words_of(t), memo), 6)[0] >= 0.4}
    assert brute == want
    ds = spark.createDataFrame(docs + [(900, None), (901, ""), (902, "a" * 100000)], "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    its = spark.createDataFrame(items + [(99, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(ds, its).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert leakage.find_leaks(ds.limit(0), its).count() == 0 and leakage.find_leaks(ds, its.limit(0)).count() == 0


def test_coverage_of_one_offset_equals_brute_force():
    import numpy as np

    item = np.arange(1, 101).astype(np.uint64)
    doc = item.copy()
    doc[25:60] = doc[85:] = 999
    assert leakage.coverage(item, doc, 6) == (0.5, 2)
    r = random.Random(1)
    for n in [40, 60, 80] * 25:
        item = np.arange(1, n + 1).astype(np.uint64)
        doc, pos = item.copy(), 0
        while pos < n:
            pos += r.randint(3, 20)
            gap = r.randint(1, 12)
            doc[pos : pos + gap] = 999
            pos += gap
        ok = [x == y for x, y in zip(item, doc)]
        runs = [(a, b) for a in range(n) for b in range(a + 6, n + 1) if ok[a] and ok[b - 1] and 8 * (b - a - sum(ok[a:b])) <= b - a]
        want = max([b - a for a, b in runs] + [b - a + d - c for a, b in runs for c, d in runs if c >= b], default=0)
        assert leakage.coverage(item, doc, 6)[0] == pytest.approx(want / n)


def test_blocks_of_items(spark, monkeypatch):
    items, docs, want = leak_case()
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 5)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(got & want) >= 0.97 * len(want)


def test_cgk_keeps_close_strings_close():
    r = random.Random(2)
    s = leakage.CgkSampler(12)
    import numpy as np

    a = np.array([r.getrandbits(60) for _ in range(12)], np.uint64)
    b = a.copy()
    b[6] = 5
    c = np.array([r.getrandbits(60) for _ in range(12)], np.uint64)
    k = lambda x: s.keys(x, np.arange(1))[:, 0]
    assert (k(a) == k(a)).all() and (k(a) == k(b)).any() and not (k(a) == k(c)).any()


def test_walks_reach_their_recall():
    import numpy as np

    for w in (9, 20, 45):
        assert leakage.walks_for(w) < leakage.MOST_WALKS
        rng, sam = np.random.default_rng(99), leakage.CgkSampler(w, walks=leakage.walks_for(w))
        hit = 0
        for _ in range(300):
            a = rng.integers(1, 1 << 62, w).astype(np.uint64)
            b = a.copy()
            b[rng.choice(w, w // 8, replace=False)] = 7
            hit += (sam.keys(a, np.arange(1)) == sam.keys(b, np.arange(1))).any()
        assert hit >= 0.9 * 300


def test_items_of_every_length_and_two_places_on_one_offset(spark):
    r = random.Random(4)
    words = ["v%d" % k for k in range(900)]
    items, docs, want = [], [], set()
    for k, n in enumerate((18, 30, 60, 110, 200, 400) * 3):
        w = [r.choice(words) for _ in range(n)]
        items.append((k, " ".join(w)))
        half = -(-n * 5 // 20)  # two places of a quarter each, the words between overwritten one by one
        x = w[:half] + ["zz%d" % j for j in range(n // 4)] + w[half + n // 4 : 2 * half + n // 4]
        docs.append((k, " ".join(["before"] * 9 + x + ["after"] * 9)))
        want.add((k, k))
    sub = lambda t: spark.createDataFrame(t, "doc_id bigint, text string")
    got = leakage.find_leaks(sub(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and {x["places"] for x in got} == {2} and {x["edits"] for x in got} == {0}


def test_banded_alignment_equals_the_full_one():
    import numpy as np

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(5)
    for _ in range(200):
        a = [r.randint(1, 4) for _ in range(r.randint(0, 12))]
        b = [r.randint(1, 4) for _ in range(r.randint(0, 12))]
        assert leakage.aligned_edits(np.array(a, np.uint64), np.array(b, np.uint64), 4) == min(5, full(a, b))


# Mixing ---------------------------------------------------------------------------------------------

def test_water_filling():
    g = mixing.water_fill({"a": 100, "b": 10, "c": 1000}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "d": (0.0, 9)}, 600)
    assert g["a"] == 100 and g["b"] == 20 and g["c"] == pytest.approx(480)
    assert sum(mixing.water_fill({"a": 5}, {"a": (1.0, 3)}, 1e9).values()) == 15
    even = mixing.water_fill({"a": 1000, "b": 1000}, {"a": (0.7, 1), "b": (0.3, 1)}, 1000)
    assert even == pytest.approx({"a": 700, "b": 300})


def test_mixture(spark):
    docs = [(k, "News Wire" if k % 3 == 0 else "memo", "word " * (k % 40 + 1)) for k in range(600)] + [(900, None, "x"), (901, "memo", None), (902, "memo", ""), (903, "blog", "y")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("news_wire", 0.6, 3), ("memo", 0.4, 1), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix_records(d, t, TOKENIZER)
    rep = {r["source_key"]: r for r in report.collect()}
    assert abs(rep["news_wire"]["actual_share"] - 0.6) < 0.01 and rep["news_wire"]["most_repeats"] <= 3 and rep["memo"]["most_repeats"] <= 1
    used = chosen.groupBy("source_key").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()
    assert {r["source_key"]: r["t"] for r in used} == {s: r["tokens_used"] for s, r in rep.items() if r["tokens_used"]}
    again = mixing.mix_records(d, t, TOKENIZER)[0]
    assert chosen.exceptAll(again).count() == 0
    assert mixing.mix_records(d.limit(0), t, TOKENIZER)[0].count() == 0


# Sentences ------------------------------------------------------------------------------------------

MODEL = [("en", "abbr", "dr", "", 0.0), ("en", "abbr", "inc", "", 1.0), ("en", "abbr", "approx", "", 0.0), ("en", "start", "the", "", 1.0), ("en", "lower", "the", "", 1.0), ("de", "coll", "#1", "quartal", 1.0), ("en", "coll", "no", "#", 1.0), ("th", "open", "รายได", "", 1.0)]


@pytest.mark.parametrize("text,want", [
    ("Dr. Oak met Inc. staff. It rose by 3.5 p.c. today! Why?", ["Dr. Oak met Inc. staff.", "It rose by 3.5 p.c. today!", "Why?"]),
    ("“We wait. Nothing else”, he said. “Yes.” Next came the rest.", ["“We wait. Nothing else”, he said.", "“Yes.”", "Next came the rest."]),
    ("(All of it was tested.) See No. 5 now.", ["(All of it was tested.)", "See No. 5 now."]),
    ("SCOPE\n\n• First point;\n* Second point\n\nThe text goes\non here. Done.", ["SCOPE", "First point;", "Second point", "The text goes\non here.", "Done."]),
    ("Im 3. Quartal stieg der Umsatz und die Bank verwies auf das Register.", ["Im 3. Quartal stieg der Umsatz und die Bank verwies auf das Register."]),
    ("银行说：“还没有到。”毛利低于预期！据Mesgu Inc. 披露，好。“在哪里？”银行问道。", ["银行说：“还没有到。”", "毛利低于预期！", "据Mesgu Inc. 披露，好。", "“在哪里？”银行问道。"]),
    ("รายได้ในปี 2016 อยู่ที่ 2.5 ล้านบาท รายได้เพิ่มขึ้น", ["รายได้ในปี 2016 อยู่ที่ 2.5 ล้านบาท", "รายได้เพิ่มขึ้น"]),
    ("The end.Next one starts. iTunes fell.", ["The end.", "Next one starts.", "iTunes fell."]), ("", []), ("   \n ", []), ("no marks at all", ["no marks at all"]),
])
def test_units(text, want):
    s = sentences.Splitter(MODEL)
    assert [text[a:b] for a, b in s.units(text, "en")] == want


def test_nothing_is_lost():
    from ledgerlens.llm.pii_train import made_texts

    s = sentences.Splitter(MODEL)
    for t, _ in made_texts(60, 8):
        held = "".join(t[a:b] for a, b in s.units(t, "en"))
        assert "".join(held.split()) == "".join(t.split())


def test_learned_model(spark):
    r = random.Random(1)
    lines = []
    for k in range(300):
        lines.append((k, " ".join(r.choice(["He met Dr. Oak today.", "It cost approx. ten pounds.", "The board approved it.", "Sales fell in the north."]) for _ in range(4)), "en"))
    d = spark.createDataFrame(lines + [(900, None, None), (901, "", "xx")], "doc_id bigint, text string, lang string")
    m = sentences.learn(d)
    abbr = {x["w"] for x in m.where("what = 'abbr'").collect()}
    assert {"dr", "approx"} <= abbr and not {"today", "pounds", "it", "north"} & abbr
    u = sentences.split_sentences(d, m)
    assert u.count() == 1200 and u.where("sentence like '%Dr.'").count() == 0
    assert sentences.split_sentences(d.limit(0), sentences.learn(d.limit(0))).count() == 0


def test_script_of_the_whole_paragraph():
    assert sentences.script_of("a" * 20_500 + "ก" * 30_000) == "th" and sentences.script_of("ก" * 20_500 + "a" * 30_000) == "latin"


def test_token_counts_of_long_texts_are_exact(spark, monkeypatch):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(TOKENIZER, "rb") if x.strip())}
    enc = tiktoken.Encoding("ranks", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(mixing, "PART_CHARS", 50)
    r = random.Random(6)
    texts = ["".join(r.choice(["word", " a", "  ", "\n\n", "’s", "'ll", "12", "%", "é", "x" * 70, "\t"]) for _ in range(400)) for _ in range(20)] + ["", " " * 500, "y" * 500]
    got = mixing.count_tokens(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), TOKENIZER).collect()
    assert {x["k"]: x["n_tokens"] for x in got} == {k: len(enc.encode_ordinary(t)) for k, t in enumerate(texts)}


def _speech(spark):
    r = random.Random(8)
    small = {"it": "il la che di non per una con del nella".split(), "pl": "jest nie się na do że przez oraz tylko jak".split(), "en": "the of and to in is that for was by".split()}
    rows = []
    for k in range(240):
        lang = ("it", "pl", "en")[k % 3]
        body = " ".join(r.choice(small[lang]) + " " + "".join(r.choice("aeioubcdlmnrst") for _ in range(7)) for _ in range(8))
        short = {"it": "avv.", "pl": "prof.", "en": "dept."}[lang]
        rows.append((k, f"{body.capitalize()} {short} Rossi {r.choice(small[lang])}. {body.capitalize()} x.", lang if k % 7 else None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_are_learned_from_labels(spark):
    rows = sentences.learn_languages(_speech(spark)).collect()
    langs = sentences._languages(rows)
    assert {"it", "pl", "en"} <= set(langs.rows)
    assert langs.of("nie tylko przez", None) == "pl" and langs.of("che non per una", "en") == "it" and langs.of("the of and", "pl") == "en"
    assert langs.of("", "pl") == "pl" and langs.of("", None) == "en"


def test_large_sentence_models_are_joined(spark, monkeypatch):
    d = _speech(spark).unionByName(spark.createDataFrame([(900, "ก" * 6 + " ข" * 9, "th"), (901, "", "en"), (902, None, None), (3, "One. Two.", "en"), (3, "One. Two.", "en")], "doc_id bigint, text string, lang string"))
    m = sentences.learn(d)
    small = sorted(tuple(x) for x in sentences.split_sentences(d, m).collect())
    monkeypatch.setattr(sentences, "MOST_MODEL", 10)
    assert sorted(tuple(x) for x in sentences.split_sentences(d, m).collect()) == small and len(small) > 400


def test_long_addresses_and_known_surnames():
    known = {"price", "banks", "grant", "the", "was", "here", "written", "by", "street", "and"}
    f = pii.PiiFinder(known)
    local, domain = "a" * 95, ".".join(["part"] * 9 + ["example"])
    t = f"Contact: {local}@{domain} was here"
    assert (9, 9 + len(local) + 1 + len(domain), "email") in f.find(t)
    for name in ("Anna Price", "John Banks", "Paul Grant"):
        assert (0, len(name), "person_name") in f.find(f"{name} and the clinic painted the fence.")


def test_many_known_words_are_joined(spark, monkeypatch):
    texts = [(str(k), t) for k, (t, _) in enumerate(pii_train.made_texts(60, 77))] + [("e", ""), ("n", None), ("0", pii_train.made_texts(1, 77)[0][0])]
    d = spark.createDataFrame(texts, "rec string, text string")
    plain = sorted(tuple(r) for r in pii.find_pii(d, ["rec"]).collect())
    red = sorted(map(str, pii.redact_pii(d).collect()))
    monkeypatch.setattr(pii, "MOST_KNOWN", 10)
    assert sorted(tuple(r) for r in pii.find_pii(d, ["rec"]).collect()) == plain and len(plain) > 30
    assert sorted(map(str, pii.redact_pii(d).collect())) == red


def test_recall_on_unseen_wording():
    got = pii_train.accuracy(pii.load_weights(), pii_train.unseen_texts(300, 123))
    assert all(p >= 0.85 and r >= 0.85 for p, r in got.values()), got


def test_aliases_are_a_parameter_and_learned(spark):
    cities = spark.createDataFrame([(1, "c", "Munich"), (2, "c", "Cologne"), (3, "c", "Vienna"), (4, "c", "Graz")], "id int, kind string, city string")
    typed = spark.createDataFrame([(1, "c", "muenchen"), (2, "c", "MUNICH, Bavaria"), (3, "c", "Köln"), (4, "c", None), (5, "c", "")], "k int, kind string, typed string")
    al = spark.createDataFrame([("Munich", "muenchen"), ("Cologne", "köln"), (None, "x")], "name string, alias string")
    got = {r["k"]: r["canonical_id"] for r in canonical.map_names(typed, cities, "kind", "typed", "kind", "id", "city", ["k"], al).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: None, 5: 0}
    r = random.Random(12)
    names = [f"entry{chr(97 + k) * 3}" for k in range(12)]
    entries = spark.createDataFrame([(k + 1, "g", n) for k, n in enumerate(names)], "id int, kind string, name string")
    rows = []
    for case in range(400):
        for k in r.sample(range(12), 7):
            text = "monthly outlay" if k == 0 and r.random() < 0.3 else "monthly outlya" if k == 0 and r.random() < 0.03 else names[k]
            rows.append((case, "g", text))
        if r.random() < 0.2:
            rows.append((case, "g", "balancing figure"))
    out = canonical.map_names(spark.createDataFrame(rows, "case int, kind string, typed string"), entries, "kind", "typed", "kind", "id", "name", ["case"], None, "case")
    by = {r["typed"]: (r["canonical_id"], r["match_kind"]) for r in out.select("typed", "canonical_id", "match_kind").distinct().collect()}
    assert by["monthly outlay"] == (1, "learned") and by["monthly outlya"] == (1, "learned") and by["balancing figure"][0] == 0 and by[names[3]][0] == 4


def test_two_lines_and_any_width():
    rep = ocr.Repairer({w: 500 for w in "the selling shareholders signed off mostly notes on".split()}, {}, set())
    f, fixed = rep.findings("The selling sharehold-\ners signed off m0stly.")
    assert fixed == "The selling shareholders signed off mostly." and (0, "hyphen", "shareholders") in f and (1, "char", "mostly") in f
    assert rep.findings("One line only, m0stly.")[0] == [] and rep.findings("signed off\nmostly notes")[0] == []


def test_unlisted_edits_need_a_neighbour():
    words = {w: 5000 for w in "the quarterly statement shows revenue of goodwill and other costs in this period below".split()}
    wrapped = "the quarterly stazement shows revenue of\ngoodwill and other costs in this period\nthe quarterly statement shows revenue of\ngoodwill and other costs in this period."
    assert not [x for x in ocr.Repairer(words, {}, set()).findings(wrapped)[0] if x[1] == "char"]
    assert (0, "char", "statement") in ocr.Repairer(words, {("quarterly", "statement"): 50}, set()).findings(wrapped)[0]


def test_confusion_costs_follow_the_corpus():
    costs = ocr.learned_costs({("0", "o"): 900, ("rn", "m"): 5})
    assert costs[("0", "o")] < costs[("rn", "m")] <= costs[("q", "g")] and ocr.learned_costs({}) == {}
    assert ocr.confusion_of("rnodern", "modern") == ("rn", "m") and ocr.confusion_of("abc", "xyz") is None


def test_scans_with_large_vocabularies_are_joined(spark, small, monkeypatch):
    d = spark.read.parquet(f"{small}/chunks.parquet").select("chunk_id", "content").unionByName(spark.createDataFrame([("n", None), ("e", ""), ("e", "")], "chunk_id string, content string"))
    plain = sorted(map(str, ocr.repair_scans(d).collect()))
    monkeypatch.setattr(ocr, "MOST_WORDS", 50)
    monkeypatch.setattr(ocr, "MOST_PAIRS", 50)
    joined = sorted(map(str, ocr.repair_scans(d).collect()))
    assert joined == plain and any("noise_kind='char'" in x for x in plain)

"""Evaluation passages inside training documents.

Words of documents and items become symbols. Windows of item size (the shortest stretch that the larger of
two places must hold, a step of LADDER) are embedded by CGK random walks, which turn edit distance into Hamming
distance; repeated samples of the embedded symbols are the LSH keys, as many as reach a target recall. Each pair
of document and item with an equal key is verified over the whole text: maximal runs with at most one word in
eight replaced, joined over a few inserted or dropped words, and the edit distance of each place by banded
alignment.

Defined results: null and blank texts leak nothing; an item of fewer words than a window is found by a
window of its own length; repeated documents or items are each reported; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, kept, spread

MASK = (1 << 64) - 1
COVER, REPLACED = 0.4, 8
SAMPLES, PICKED, MOST_WALKS = 6, 9, 24
#: Chance that a window with as many words replaced as allowed shares a key with its original.
RECALL = 0.95
#: Sizes of windows; items use the largest that their shortest stretch holds.
LADDER = (4, 6, 9, 13, 20, 30, 45, 68, 102, 153, 230, 345, 518, 777, 1166)
#: Words that one place may have inserted or dropped between two runs.
GAP = 3
#: Least share of a window's neighbouring words that must be neighbours in some item. A place's runs of eight
#: words with one replaced and GAP inserted between keep 5 of 11, so no leak falls below it everywhere.
NEIGHBOURS = 0.4
BLOCK_ITEMS = 20_000
BATCH_WORDS = 60_000


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold())


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over arrays."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def symbols(words: list[str], memo: dict[str, int]) -> np.ndarray:
    import xxhash

    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            if len(memo) > 2_000_000:
                memo.clear()
            h = memo[w] = xxhash.xxh64_intdigest(w.encode()) | 1
        out[k] = h
    return out


class CgkSampler:
    """Keys of all windows of a symbol array: ``walks`` walks of 3 x window steps, SAMPLES keys each."""

    def __init__(self, window: int, seed: int = 17, walks: int = 4, samples: int = SAMPLES, picked: int = PICKED):
        self.window, self.seed, self.walks, self.samples, self.picked = window, seed, walks, samples, picked
        rng = np.random.default_rng(seed)
        self.steps = 3 * window
        # Late steps mostly read padding; samples come from the steps that read symbols.
        top = max(picked, int(self.steps * 0.62))
        self.at = [[np.sort(rng.choice(top, picked, replace=False)) for _ in range(samples)] for _ in range(walks)]

    def keys(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(walks x samples, windows) keys; a window ends with the text or its start's segment."""
        n, w = len(starts), self.window
        out = np.empty((self.walks * self.samples, n), np.uint64)
        padded = np.concatenate([sym, np.zeros(w + 1, np.uint64)])
        for r in range(self.walks):
            bits = _mix(padded, self.seed + r)
            need = sorted({int(p) for s in self.at[r] for p in s})
            read: dict[int, np.ndarray] = {}
            idx, end = starts.copy(), starts + w
            for j in range(max(need) + 1):
                inside = idx < end
                if j in need:
                    read[j] = np.where(inside, padded[idx], np.uint64(0))
                idx = idx + np.where(inside, (bits[idx] >> np.uint64(j)) & np.uint64(1), np.uint64(0)).astype(np.int64)
            for s, at in enumerate(self.at[r]):
                k = np.full(n, self.seed + 31 * r + s, np.uint64)
                for p in at:
                    k = _mix(k ^ read[int(p)], 7)
                out[r * self.samples + s] = k
        return out


@lru_cache(maxsize=None)
def walks_for(window: int, recall: float = RECALL, seed: int = 17, samples: int = SAMPLES, picked: int = PICKED, trials: int = 600) -> int:
    """The fewest walks with which random windows, one word in REPLACED replaced, share a key with their original
    in at least ``recall`` of the trials."""
    rng = np.random.default_rng(seed)
    sam = CgkSampler(window, seed, MOST_WALKS, samples, picked)
    a = rng.integers(1, 1 << 62, (trials, window)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(window, window // REPLACED, replace=False)] = rng.integers(1, 1 << 62, window // REPLACED).astype(np.uint64)
    flat = lambda x: np.concatenate([np.concatenate([r, np.zeros(window, np.uint64)]) for r in x])
    at = np.arange(trials) * 2 * window
    same = (sam.keys(flat(a), at) == sam.keys(flat(b), at)).reshape(MOST_WALKS, samples, trials).any(axis=1)
    for k in range(1, MOST_WALKS + 1):
        if same[:k].any(axis=0).mean() >= recall:
            return k
    return MOST_WALKS


def aligned_edits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of two word sequences by a banded alignment; band + 1 if it is larger than the band."""
    if abs(len(a) - len(b)) > band:
        return band + 1
    prev = {j: j for j in range(min(len(b), band) + 1)}
    for i, x in enumerate(a.tolist(), 1):
        cur = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            far = band + 1
            cur[j] = i if j == 0 else min(prev.get(j, far) + 1, cur.get(j - 1, far) + 1, prev.get(j - 1, far) + (x != b[j - 1]))
        prev = cur
    return min(prev.get(len(b), band + 1), band + 1)


def segments(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of ungapped runs of at least ``least`` words, at most one word in
    REPLACED replaced: on each diagonal the longest, then the longest left and right of it, and so on; besides
    the two that together are longest, where these are others."""
    n = len(item)
    order = np.argsort(item, kind="stable")
    lo = np.searchsorted(item[order], doc, "left")
    hi = np.searchsorted(item[order], doc, "right")
    count = hi - lo
    total = int(count.sum())
    if not total:
        return []
    j = np.repeat(np.arange(len(doc)), count)
    i = order[np.repeat(lo, count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]
    by = np.lexsort((i, j - i))
    i, diag = i[by], (j - i)[by]
    at = np.concatenate([[0], np.nonzero(np.diff(diag))[0] + 1, [total]])
    out = []
    for k in np.nonzero(np.diff(at) >= least - least // REPLACED)[0]:
        d, hits = int(diag[at[k]]), i[at[k] : at[k + 1]].tolist()
        ok = np.zeros(n, bool)
        ok[hits] = True
        pre = np.concatenate([[0], np.cumsum(np.where(ok, 1, 1 - REPLACED))])
        starts = sorted(i for i in hits if i == 0 or not ok[i - 1])
        ends = sorted(i + 1 for i in hits if i + 1 == n or not ok[i + 1])

        def longest(lo: int, hi: int) -> tuple[int, int]:
            best = (0, 0)
            for a in starts:
                if a < lo:
                    continue
                for b in reversed(ends):
                    if b > hi:
                        continue
                    if b - a <= best[1] - best[0]:
                        break
                    if pre[b] - pre[a] >= 0:
                        best = (a, b)
                        break
            return best if best[1] - best[0] >= least else (0, 0)

        runs: list[tuple[int, int]] = []
        todo = [(0, n)]
        while todo:
            lo_i, hi_i = todo.pop()
            a, b = longest(lo_i, hi_i)
            if b:
                runs.append((a, b))
                todo += [(x, y) for x, y in ((lo_i, a), (b, hi_i)) if y - x >= least]
        if runs:
            pair = max(((longest(0, x), longest(x, n)) for x in starts[1:]), key=lambda p: sum(b - a for a, b in p), default=())
            if sum(b - a for a, b in pair) > sum(sorted(b - a for a, b in runs)[-2:]):
                runs += [r for r in pair if r[1] and r not in runs]
        out += [(a, a + d, b - a) for a, b in runs]
    return out


def places(segs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Runs joined over an inserted or dropped word: (item start, item end, doc start, doc end, words)."""
    out: list[list[int]] = []
    for i, d, ln in sorted(segs):
        # Runs at the same offset have too many words replaced between them to be one place.
        p = next((p for p in reversed(out) if 0 <= i - p[1] <= GAP and 0 <= d - p[3] <= GAP and i - p[1] != d - p[3]), None)
        if p:
            p[1], p[3], p[4] = i + ln, d + ln, p[4] + ln
        else:
            out.append([i, i + ln, d, d + ln, ln])
    return [tuple(p) for p in out]


def held(item: np.ndarray, doc: np.ndarray, least: int, cover: float = 0.0) -> tuple[float, int, int]:
    """Largest share of the item's words held in order in one or two places, their number, and the edits between
    them and the item. A place whose aligned edits pass its allowance (one word in REPLACED, GAP a joint) is none.
    Below ``cover`` nothing is aligned."""
    if not len(item):
        return 0.0, 0, 0

    def edits(p: tuple) -> int | None:
        span = max(p[1] - p[0], p[3] - p[2])
        most = span // REPLACED + GAP * (span // max(least, 1) + 1)
        band = min(4, most)
        while True:  # the band doubles until it holds the distance
            e = aligned_edits(item[p[0] : p[1]], doc[p[2] : p[3]], band)
            if e <= band or band >= most:
                return e if e <= most else None
            band = min(2 * band, most)

    ps = places(segments(item, doc, least))
    while True:
        best, chosen = 0, ()
        for k, p in enumerate(ps):
            if p[4] > best:
                best, chosen = p[4], (p,)
            for q in ps[:k] + ps[k + 1 :]:
                a = max(0, p[1] - q[0])  # overlap in the item counts once
                if a and q[2] - q[0] == p[3] - p[1]:
                    continue  # two runs of one offset that overlap are no two places
                if q[0] >= p[0] and q[1] > p[1] and q[2] + a >= p[3] and q[4] > a and p[4] + q[4] - a > best:
                    best, chosen = p[4] + q[4] - a, (p, q)
        # Only what would count is aligned; a place that fails is taken out and the rest judged again.
        if best / len(item) < cover:
            return best / len(item), len(chosen), 0
        cost = [edits(p) for p in chosen]
        bad = [p for p, e in zip(chosen, cost) if e is None]
        if not bad:
            return best / len(item), len(chosen), sum(cost)
        ps = [p for p in ps if p not in bad]


def coverage(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[float, int]:
    """Share held and number of places (see ``held``)."""
    return held(item, doc, least)[:2]


def neighbours(sym: np.ndarray) -> np.ndarray:
    """One symbol for each two neighbouring words."""
    return _mix(sym[:-1], 3) ^ sym[1:]


class SizeIndex:
    """Keys of the items of one window size."""

    def __init__(self, window: int, items: list[tuple[int, np.ndarray]], recall: float, **lsh: int):
        self.window = window
        self.sampler = CgkSampler(window, **{"walks": walks_for(window, recall), **lsh})
        self.pairs = np.unique(np.concatenate([neighbours(s) for _, s in items]))
        tables: list[list[np.ndarray]] = []
        owner = []
        for k, s in items:
            st = np.arange(max(1, len(s) - window + 1))
            tables.append(self.sampler.keys(s, st))
            owner.append(np.full(len(st), k))
        own, allk = np.concatenate(owner), np.concatenate(tables, axis=1)
        self.tables = []
        for row in allk:
            both = np.unique(np.stack([row, own.astype(np.uint64)]), axis=1)
            self.tables.append((both[0], both[1].astype(np.int64)))

    def windows(self, sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which windows have enough words that are neighbours in some item; the others can hold no leak."""
        if not len(self.pairs):
            return np.ones(len(starts), bool)
        h = neighbours(sym)
        at = np.minimum(np.searchsorted(self.pairs, h), len(self.pairs) - 1)
        known = np.concatenate([[0], np.cumsum(self.pairs[at] == h)])
        size = np.minimum(starts + self.window, ends) - starts
        last = np.minimum(starts + np.maximum(size - 1, 0), len(h))
        return known[last] - known[np.minimum(starts, len(h))] >= NEIGHBOURS * (size - 1)


class LeakIndex:
    """The index of one block of items, small enough to travel with the tasks."""

    def __init__(self, items: list[tuple[int, str]], least: int = 6, cover: float = COVER, recall: float = RECALL, **lsh: int):
        self.memo: dict[str, int] = {}
        texts = [(i, symbols(words_of(t), self.memo)) for i, t in items if isinstance(t, str)]
        self.items = [(i, s) for i, s in texts if len(s)]
        self.cover = cover
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.least: list[int] = []
        for k, (_, s) in enumerate(self.items):
            shortest = max(LADDER[0], -int(-len(s) * cover // 2) - 1)
            w = max(x for x in LADDER if x <= shortest)
            self.least.append(min(least, w))
            by.setdefault(w, []).append((k, s))
        self.sizes = [SizeIndex(w, own, recall, **lsh) for w, own in sorted(by.items())]

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document position, item position) pairs that share a key."""
        got: list[np.ndarray] = []
        if not docs:
            return set()
        for ix in self.sizes:
            w = ix.window
            gap = np.zeros(w, np.uint64)
            sym = np.concatenate([x for d in docs for x in (d, gap)])
            lens = np.array([len(d) for d in docs])
            offs = np.concatenate([[0], np.cumsum(lens + w)[:-1]])
            count = np.maximum(1, lens - w + 1)
            own = np.repeat(np.arange(len(docs)), count)
            starts = np.repeat(offs, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            keep = ix.windows(sym, starts, np.repeat(offs + lens, count))
            starts, own = starts[keep], own[keep]
            for a in range(0, len(starts), BATCH_WORDS):
                st, ow = starts[a : a + BATCH_WORDS], own[a : a + BATCH_WORDS]
                for row, (keys, item) in zip(ix.sampler.keys(sym, st), ix.tables):
                    lo, hi = np.searchsorted(keys, row, "left"), np.searchsorted(keys, row, "right")
                    h = np.nonzero(hi > lo)[0]
                    count = (hi - lo)[h]
                    at = np.repeat(lo[h], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    got.append(np.unique(np.repeat(ow[h], count) * len(self.items) + item[at]))
        pairs = np.unique(np.concatenate(got)) if got else np.empty(0, np.int64)
        return {(int(x) // len(self.items), int(x) % len(self.items)) for x in pairs}

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(text position, item id, coverage, places, edits) of texts that hold enough of an item."""
        docs = [symbols(words_of(t), self.memo) if isinstance(t, str) else np.empty(0, np.uint64) for t in texts]
        out = []
        found = sorted(self.candidates(docs))
        seen = {d: np.unique(docs[d]) for d in {d for d, _ in found}}
        for d, k in found:
            i, s = self.items[k]
            if np.isin(s, seen[d]).mean() < self.cover * (1 - 1 / REPLACED):
                continue  # too few of its words anywhere in the text
            c, n, e = held(s, docs[d], self.least[k], self.cover)
            if c >= self.cover - 1e-9:
                out.append((d, i, c, n, e))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **index: float) -> DataFrame:
    """doc_id, item_id, coverage, places, edits of every document that holds enough of an item.

    Items are the stated query set; they travel in blocks of BLOCK_ITEMS, however many there are. The
    documents are read once a block and never shuffled by key.
    """
    listed = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    blocks = -(-listed.count() // BLOCK_ITEMS) or 1
    src = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, coverage double, places int, edits int"
    out = None
    for b in range(blocks):
        own = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        rows = [(r["i"], r["t"]) for r in bounded_rows(own, 2 * BLOCK_ITEMS, "block of items")]

        token = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], rows=rows, token=token) -> Iterator[pd.DataFrame]:
            ix = kept(token, lambda: LeakIndex(rows, **index))
            for p in batches:
                got = ix.leaks(list(p["text"]))
                ids = list(p["doc_id"])
                yield pd.DataFrame([(ids[d], *rest) for d, *rest in got], columns=["doc_id", "item_id", "coverage", "places", "edits"])

        part = src.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out

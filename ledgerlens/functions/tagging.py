"""Tagging and normalisation of financial text, as Arrow-batched functions.

Defined results: null stays null, empty stays empty; numbers that can't be read stay as written.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V

_MONEY, _UNITS = re.compile(V.MONEY_PHRASES, re.I), re.compile(V.UNIT_PHRASES, re.I)
_TITLES, _PERIODS, _DATES = re.compile(V.STATEMENT_TITLES, re.I), re.compile(V.PERIOD_PHRASES, re.I), re.compile(V.DATE_PHRASES, re.I)
_MONEY_PARTS = re.compile(r"([$€£¥]|[A-Za-z]{3})\s*([\d.,]+)\s*(million|billion|trillion|m|b|t)?", re.I)
_TERMS = sorted(((t, tag) for tag, ts in V.FINANCIAL_TERMS.items() for t in ts), key=lambda x: (-len(x[0]), x[0]))
_TERM_TAG = {}
for _t, _tag in _TERMS:
    _TERM_TAG.setdefault(_t.lower(), _tag)
_TERM_RE = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t) for t, _ in _TERMS) + r")(?!\w)", re.I)
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}


def normalize_money(text: str) -> str:
    """Amounts as currency and plain number with two decimals."""

    def one(m: re.Match) -> str:
        p = _MONEY_PARTS.fullmatch(m.group().strip())
        try:
            return f"{p[1]}{float(p[2].replace(',', '')) * SCALES.get((p[3] or '').lower(), 1):.2f}"
        except (ValueError, TypeError):
            return m.group()

    return _MONEY.sub(one, text)


def normalize_units(text: str) -> str:
    """Numbers with unit words as plain numbers with two decimals; percentages keep their sign."""

    def one(m: re.Match) -> str:
        n = re.match(r"\d+(?:\.\d+)?", m.group())
        unit = m.group()[n.end() :].strip().lower()
        return f"{float(n.group())}%" if unit in ("percent", "%") else f"{float(n.group()) * SCALES[unit]:.2f}"

    return _UNITS.sub(one, text)


def mark_terms(text: str) -> str:
    """Dictionary terms in tags of their category, the longest first."""
    return _TERM_RE.sub(lambda m: f"[{_TERM_TAG[m.group().lower()]}]{m.group()}[/{_TERM_TAG[m.group().lower()]}]", text)


def statement_tag(title: str) -> str:
    t = re.sub(r"\s+", " ", title.lower())
    for words, tag in ((("balance sheet", "financial position"), "BALANCE_SHEET"), (("income statement", "profit and loss", "operations"), "INCOME_STATEMENT"), (("cash flow",), "CASH_FLOW"), (("changes in equity",), "EQUITY_STATEMENT"), (("comprehensive income",), "COMPREHENSIVE_INCOME")):
        if any(w in t for w in words):
            return tag
    return "STATEMENT"


def mark_statements(text: str) -> str:
    return _TITLES.sub(lambda m: f"[{statement_tag(m.group())}]{m.group()}[/{statement_tag(m.group())}]", text)


def mark_periods(text: str) -> str:
    """Period phrases that lie in no date, in tags."""
    dates = [m.span() for m in _DATES.finditer(text)]
    free = lambda m: all(m.start() >= e or m.end() <= s for s, e in dates)
    return _PERIODS.sub(lambda m: f"[PERIOD]{m.group()}[/PERIOD]" if free(m) else m.group(), text)


def mark_tables(text: str) -> str:
    """Runs of lines split by bars (or else commas) in TABLE, ROW and CELL tags."""
    out: list[str] = []
    for line in text.split("\n"):
        sep = "|" if "|" in line.strip(" |") else "," if "," in line.strip(" ,") else ""
        if not sep or not line.strip():
            out.append(line)
            continue
        row = "[ROW]" + sep.join(f"[CELL]{c.strip()}[/CELL]" for c in line.strip().split(sep)) + "[/ROW]"
        if out and out[-1].endswith("[/TABLE]"):
            out[-1] = out[-1][: -len("[/TABLE]")] + "\n" + row + "[/TABLE]"
        else:
            out.append(f"[TABLE]{row}[/TABLE]")
    return "\n".join(out)


def process_text(text: str) -> str:
    """All steps in order, blanks collapsed first. Money is normalised before tables split at commas, so a
    thousands separator makes no cells."""
    t = re.sub(r"[^\S\n]+", " ", text).strip()
    return normalize_units(mark_tables(mark_periods(mark_statements(mark_terms(normalize_money(t))))))


STEPS: dict[str, Callable[[str], str]] = {"money": normalize_money, "units": normalize_units, "terms": mark_terms, "statements": mark_statements, "period": mark_periods, "tables": mark_tables, "all": process_text}


def tag_text(text: Column, step: str = "all") -> Column:
    f = STEPS[step]

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x) if isinstance(x, str) else None)

    return apply(text)


def format_ratio(value: Column, is_percentage: Column, is_multiple: Column, places: int = 2) -> Column:
    """N/A, a percentage, a multiple or a plain number, rounded as the binary value prints."""

    @F.pandas_udf("string")
    def apply(v: pd.Series, p: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(["N/A" if x != x or x is None else f"{x * 100:.{places}f}%" if a else f"{x:.{places}f}x" if b else f"{x:.{places}f}" for x, a, b in zip(v, p, m)])

    return apply(value, is_percentage, is_multiple)

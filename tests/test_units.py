import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.units import normalize_units, unit_repairs

CATALOG = [("USD", "money", "USD", 1.0), ("EUR", "money", "EUR", 1.0), ("INR", "money", "INR", 1.0), ("USc", "money", "USD", 0.01), ("GBX", "money", "GBP", 0.01), ("GBP", "money", "GBP", 1.0), ("CHF", "money", "CHF", 1.0), ("shares", "shares", "shares", 1.0), ("ratio", "ratio", "ratio", 1.0), ("pct", "ratio", "ratio", 0.01), ("bps", "ratio", "ratio", 0.0001), ("MWh", "energy", "MJ", 3600.0), ("MJ", "energy", "MJ", 1.0), ("t", "mass", "kg", 1000.0), ("kt", "mass", "kg", 1e6), ("km2", "area", "m2", 1e6)]
SCHEMA = "item_id bigint, currency string, value double, raw_value string, unit string, scaling_factor double"
CASES = [  # currency, value, raw, unit, scaling, common unit, amount
    ("USD", 1694.0, "1,694", "MWh", 1.0, "MJ", 6098400.0), ("JPY", None, "USD 1 020 481,77 thousand", "EUR", None, "USD", 1020481770.0), ("USD", 28659.0, "28.659", "USD", 1000.0, "USD", 28659000.0),
    ("EUR", -5879.51, "-5,879.51 m", "EUR", 1.0, "EUR", -5879510000.0), ("CHF", 1404534.72, "1'404'534.72", "CHF", 1.0, "CHF", 1404534.72), ("USD", 2.5e10, "25 Mrd.", "USD", 1e9, "USD", 2.5e10), ("EUR", 265.8, "265,80", "EUR (000)", 1000.0, "EUR", 265800.0),
    ("GBP", None, "GBP 80.0 Mio.", "", None, "GBP", 80e6), ("INR", 9764044.0, "97,64,044", None, 1.0, "INR", 9764044.0), ("USD", -4932964.0, "4,932,964-", None, None, "USD", -4932964.0), ("USD", 0.3697, "36.97%", "%", 1.0, "ratio", 0.3697), ("USD", 37.58, "37,58", "pct", 0.01, "ratio", 0.3758),
    ("EUR", 3096.0, "3096 bp", "bps", 1.0, "ratio", 0.3096), ("GBP", 768.0, "768", "GBp", 1.0, "GBP", 7.68), ("USD", 50.0, "50", "cents", 1.0, "USD", 0.5), ("USD", 1398.0, "1,398 '000", "USD", 1.0, "USD", 1398000.0), ("USD", 1.0, "1 thousand tonnes", None, 1.0, "kg", 1e6),
    ("JPY", 0.3, "0.3 km2", None, 1.0, "m2", 300000.0), ("INR", 10.6, "Rs.10.6 crore", None, None, "INR", 106000000.0), ("USD", 1161919.0, "(1,161,919)", "USD", 1.0, "USD", 1161919.0), ("USD", None, "(1,161,919)", "USD", 1.0, "USD", -1161919.0), ("USD", None, "3,096", "kUSD", None, "USD", 3096000.0),
]


def test_each_manner_of_writing(spark):
    rows = [(k, c, v, r, u, s) for k, (c, v, r, u, s, *_) in enumerate(CASES)]
    out = {x["item_id"]: x for x in normalize_units(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(CATALOG, "unit_code string, quantity string, common_unit string, factor double")).collect()}
    for k, case in enumerate(CASES):
        assert out[k]["common_unit"] == case[5], case
        assert float(out[k]["amount"]) == pytest.approx(case[6]), case


def test_unreadable_null_empty_and_repeated(spark):
    cat = spark.createDataFrame(CATALOG, "unit_code string, quantity string, common_unit string, factor double")
    rows = [(1, "USD", None, "n/a", "USD", 1.0), (2, None, None, None, None, None), (3, "USD", None, "see note 5", None, None), (4, "USD", 5.0, None, "USD", 1.0), (5, "USD", 5.0, "x" * 10000, "kUSD", 1.0), (5, "USD", 5.0, "x" * 10000, "kUSD", 1.0), (6, "USD", None, "", "USD", None)]
    got = {tuple(r) for r in unit_repairs(spark.createDataFrame(rows, SCHEMA), cat).collect()}
    assert got == {(5, "USD", 50_000_000)}
    assert unit_repairs(spark.createDataFrame([], SCHEMA), cat).count() == 0
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("amount", F.lit("clash")).withColumn("other", F.lit(1))
    assert "other" in normalize_units(extra, cat).columns


def test_mixture_flags_doubtful_scale(spark):
    cat = spark.createDataFrame(CATALOG, "unit_code string, quantity string, common_unit string, factor double")
    rows = [(k, "USD", 1e9 + k * 1e6, None, "USD", 1.0) for k in range(200)] + [(900, "USD", 1000.0, None, None, None), (901, "USD", 1e9, None, None, None)]
    out = {r["item_id"]: r for r in normalize_units(spark.createDataFrame(rows, SCHEMA), cat).collect()}
    assert out[900]["unit_posterior"] < out[901]["unit_posterior"]
    assert out[900]["unit_uncertain"] and not out[901]["unit_uncertain"]


def _measured(spark, masked):
    """Energy used by site: magnitudes of one measure, recorded in kWh, MWh or GJ; unit and currency of every third row masked."""
    import random

    r = random.Random(3)
    units = {"kWh": 3.6, "MWh": 3600.0, "GJ": 1000.0, "MJ": 1.0}
    rows, true = [], {}
    for k in range(900):
        name, mean = [("Depot", 7.0), ("Smelter", 11.5), ("Office", 4.5)][k % 3]
        unit = r.choice(["kWh", "MWh"]) if name != "Office" else "MJ"
        mj = 10 ** r.gauss(mean, 0.3)
        hide = k % 3 == (k // 3) % 3 and masked
        rows.append((k, None if hide else "EUR", mj / units[unit], None, None if hide else unit, 1.0 if r.random() < 0.5 else None, name))
        if hide:
            true[k] = (unit, mj)
    cat = [("MJ", "energy", "MJ", 1.0), ("kWh", "energy", "MJ", 3.6), ("MWh", "energy", "MJ", 3600.0), ("GJ", "energy", "MJ", 1000.0), ("EUR", "money", "EUR", 1.0)]
    return spark.createDataFrame(rows, SCHEMA + ", name string"), spark.createDataFrame(cat, "unit_code string, quantity string, common_unit string, factor double"), true


def test_masked_units_are_assigned_by_posterior(spark):
    items, cat, true = _measured(spark, True)
    out = {r["item_id"]: r for r in normalize_units(items, cat, group="name").collect()}
    assert len(true) == 300
    right = [k for k, (u, mj) in true.items() if out[k]["resolved_unit"] == u and float(out[k]["amount"]) == pytest.approx(mj, rel=1e-6)]
    assert len(right) >= 0.9 * len(true)
    assert all(out[k]["unit_source"] == "mixture" and 0 < out[k]["unit_posterior"] <= 1 for k in true)
    wrong = [k for k in true if k not in right]
    assert not wrong or sum(out[k]["unit_posterior"] for k in wrong) / len(wrong) < sum(out[k]["unit_posterior"] for k in right) / len(right)


def test_a_group_without_any_unit_stays_unread(spark):
    cat = spark.createDataFrame(CATALOG, "unit_code string, quantity string, common_unit string, factor double")
    out = normalize_units(spark.createDataFrame([(1, None, 5.0, None, None, None)], SCHEMA), cat).first()
    assert out["amount"] is None and out["unit_source"] == "none"


def test_lone_full_stop_is_read_by_the_likelier_magnitude(spark):
    cat = spark.createDataFrame(CATALOG, "unit_code string, quantity string, common_unit string, factor double")
    large = [(k, "USD", None, f"{k + 1}.234.567", "USD", 1.0) for k in range(60)]
    small = [(1000 + k, "EUR", None, f"{k % 9 + 1},{k % 10}", "EUR", 1.0) for k in range(400)] + [(2000 + k, "EUR", None, f"1{k}01.234", "EUR", 1.0) for k in range(60)]
    asked = [(9001, "USD", None, "765.432", "USD", 1.0), (9002, "EUR", None, "3.125", "EUR", 1.0)]
    out = {r["item_id"]: r for r in normalize_units(spark.createDataFrame(large + small + asked, SCHEMA), cat).collect()}
    assert float(out[9001]["amount"]) == 765432 and 0.5 <= out[9001]["unit_posterior"] <= 1
    assert float(out[9002]["amount"]) == 3.125

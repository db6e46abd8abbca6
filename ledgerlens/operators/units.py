"""Quantities recorded in different units, brought to the common units of a catalog.

Printed amounts are parsed once per distinct shape (digits alike) and looked up by row; a log-scale mixture
with the catalog's conversion factors as offsets assigns what no field states.

Defined results: a null or unreadable item gives a null amount, as does one whose unit nothing states and
whose group has no item with a unit; empty tables give empty results;
repeated rows give the same amount each; further columns are kept. A name that the operator adds
(``amount``, ``common_unit``, ...) replaces an input column of that name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, broadcast_if_small, shared_checkpoint

# How sources write units and scales (compared in lower case, without full stops).
UNIT_WORDS = {
    "USD": ["usd", "$", "us$", "us dollars", "dollars"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pounds"],
    "INR": ["inr", "₹", "rs", "rupees"],
    "JPY": ["jpy", "¥", "yen"],
    "CHF": ["chf", "fr", "sfr", "francs"],
    "USc": ["usc", "us cents", "us cent"],
    "EUc": ["euc", "euro cents", "euro cent", "eurocents"],
    "GBX": ["gbx", "pence", "p"],
    "INp": ["inp", "paise", "paisa"],
    "CHr": ["chr", "rappen", "rp"],
    "MINOR": ["cents", "cent", "¢", "ct"],
    "shares": ["shares", "shs", "no of shares", "number of shares", "share"],
    "ratio": ["ratio"],
    "pct": ["pct", "%", "percent", "per cent"],
    "bps": ["bps", "bp", "basis points", "basis point"],
    "MJ": ["mj", "megajoules", "megajoule"],
    "GJ": ["gj", "gigajoules", "gigajoule"],
    "kWh": ["kwh", "kw h", "kilowatt-hours", "kilowatt hours"],
    "MWh": ["mwh", "mw h", "megawatt-hours", "megawatt hours"],
    "GWh": ["gwh", "gw h", "gigawatt-hours", "gigawatt hours"],
    "kg": ["kg", "kgs", "kilograms", "kilogram"],
    "g": ["g", "grams", "gram"],
    "t": ["t", "mt", "tonnes", "tonne", "metric tons", "metric tonnes"],
    "kt": ["kt", "kilotonnes", "kilotonne"],
    "m2": ["m2", "m²", "sqm", "sq m", "square metres", "square meters"],
    "ha": ["ha", "hectares", "hectare"],
    "km2": ["km2", "km²", "sq km", "square kilometres", "square kilometers"],
}
#: Written in this case only; in lower case they are something else.
EXACT_WORDS = {"GBp": "GBX"}
SCALE_WORDS = {
    1e3: ["k", "thousand", "thousands", "thsd", "tsd", "'000", "000", "000s", "(000)", "t'"],
    1e5: ["lakh", "lakhs", "lac", "lacs"],
    1e6: ["m", "mm", "mn", "mln", "mio", "million", "millions"],
    1e7: ["cr", "crore", "crores"],
    1e9: ["b", "bn", "mrd", "billion", "billions"],
}
PREFIXES = {"k": 1e3, "t": 1e3, "m": 1e6}
MINOR_OF = {"USD": "USc", "EUR": "EUc", "GBP": "GBX", "INR": "INp", "CHF": "CHr"}
CURRENCIES = ("USD", "EUR", "GBP", "INR", "JPY", "CHF")
#: Scales a recorded figure may carry without saying so; with the catalog's factors they offset the components.
SCALES = (1.0, 1e3, 1e5, 1e6, 1e7, 1e9)
#: Width of the bins of log10 magnitudes, in which the mixture is fitted and its posterior is read.
BIN = 0.05
#: Distinct printed forms that may travel with every task; beyond that they are joined by a shuffle.
SMALL_FORMS = 300_000
MOST_UNITS = 10_000
_GROUP = "[\\u00A0\\u202F\\u2009 '’]"
_NUMBER = rf"(\d{{1,3}}(?:{_GROUP}\d{{3}})+(?:[.,]\d+)?(?!\d)|\d[\d.,]*\d|\d)"
DEC = "decimal(26,8)"


def unit_forms() -> list[tuple[str, str | None, float | None]]:
    """(text, unit code or None, scale or None) of every writing the rules produce."""
    forms: dict[str, tuple[str | None, float | None]] = {}
    scales = [(w, s) for s, ws in SCALE_WORDS.items() for w in ws]
    for w, s in scales:
        forms[w] = (None, s)
    money = set(CURRENCIES)
    for code, words in UNIT_WORDS.items():
        for u in words:
            for w, s in scales:
                for text in (f"{u} {w}", f"{w} {u}", f"{u} ({w.strip('()')})", f"in {w} of {u}", f"{w} of {u}"):
                    forms.setdefault(text, (code, s))
                if code in money:
                    forms.setdefault(f"{u}{w}", (code, s))
            if code in money:
                for p, s in PREFIXES.items():
                    forms.setdefault(f"{p}{u}", (code, s))
    for code, words in UNIT_WORDS.items():  # a plain unit wins over a prefix reading
        for u in words:
            forms[u] = (code, None)
    return [(t, c, s) for t, (c, s) in forms.items()]


def forms_table(spark: SparkSession, prefix: str) -> DataFrame:
    rows = [(t, c, s) for t, c, s in unit_forms()]
    return spark.createDataFrame(rows, f"{prefix}_text string, {prefix}_code string, {prefix}_scale double")


def _clean(c: Column) -> Column:
    t = F.trim(F.translate(F.lower(c), "’·\u00a0\u202f.", "'   "))
    return F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, r"\s+", " ")).otherwise(t)


def _printed(items: DataFrame, raw: str = "raw_value") -> DataFrame:
    """``items`` with ``_s``: the printed text with an apostrophe's '000 told as a word and the 2 of m2 raised, so
    that all its digits are the number's; and ``_shape``."""
    s = F.col("_s")
    t = items.withColumn("_s", F.replace(F.trim(raw), F.lit("m2"), F.lit("m²")))
    t = t.withColumn("_s", F.when(F.contains(s, F.lit("'000")) | F.contains(s, F.lit("’000")), F.regexp_replace(s, r"(?<!\d)['’]000(?!\d)|(?<=,\d{3})['’]000(?!\d)", " thousand")).otherwise(s))
    return t.withColumn("_shape", _shape(s))


def _shape(c: Column) -> Column:
    """A text with all digits alike: what it states of unit, scale and separators depends on this only."""
    return F.translate(c, "0123456789", "9999999999")


def parse_shapes(shapes: DataFrame) -> DataFrame:
    """Distinct printed shapes (``shape``) with the place of the number (``at``, ``len``), its separators
    (``kind``), whether it is negative, and the text around it (``rest`` cleaned, ``exact`` as written).

    kind: 'plain' (a comma or full stop is the decimal sign), 'comma' (commas group), 'swap' (full stops group),
    'lone_comma' and 'lone_dot' (before three closing digits; they group unless the number starts with 0).
    """
    t = shapes.withColumn("_m", F.regexp_extract("shape", _NUMBER, 1))
    t = t.withColumns({"num": F.translate("_m", "\u00a0\u202f\u2009 '’", ""), "at": F.when(F.col("_m") != "", F.instr("shape", F.col("_m"))), "len": F.length("_m")})
    num = F.col("num")
    t = t.withColumns({"_c": F.length("num") - F.length(F.translate("num", ",", "")), "_d": F.length("num") - F.length(F.translate("num", ".", ""))})
    c, d = F.col("_c"), F.col("_d")
    kind = (
        F.when((c > 0) & (d > 0), F.when(F.instr(F.reverse("num"), ",") < F.instr(F.reverse("num"), "."), "swap").otherwise("comma"))
        .when(c > 1, "comma").when(d > 1, "swap")
        .when(num.rlike(r"^9{1,3},999$"), "lone_comma").when(num.rlike(r"^9{1,3}[.]999$"), "lone_dot").otherwise("plain")
    )
    around = F.when(F.col("at").isNull(), F.col("shape")).otherwise(F.concat(F.substring("shape", F.lit(1), F.col("at") - 1), F.lit(" "), F.substring("shape", F.col("at") + F.col("len"), F.length("shape"))))
    t = t.withColumns({"kind": kind, "_around": around})
    t = t.withColumns({"negative": F.contains("_around", F.lit("-")) | F.contains("_around", F.lit("−")) | F.contains("_around", F.lit("(")), "exact": F.trim(F.translate("_around", "-−()+", "     "))})
    # How the digits are brought to a plain decimal; where the number starts with 0, a lone sign is decimal.
    sign = "\u00a0\u202f\u2009 '’"
    k = F.col("kind")
    grouping = F.when((k == "comma") | (k == "lone_comma"), ",").when(k == "swap", F.when(c > 0, ",.").otherwise(".")).otherwise(",")
    point = F.when((k == "comma") | (k == "lone_comma"), "").when(k == "swap", F.when(c > 0, ".").otherwise("")).otherwise(".")
    t = t.withColumns({"take": F.concat(grouping, F.lit(sign)), "give": point, "lone": k == "lone_dot", "take0": F.when(k == "lone_comma", F.lit("," + sign)).otherwise(F.concat(grouping, F.lit(sign))), "give0": F.when(k == "lone_comma", ".").otherwise(point)})
    # What unambiguous numbers of the corpus tell of a full stop before three digits.
    t = t.withColumns({"groups": (F.col("kind") == "swap"), "decimals": (F.col("kind") != "lone_dot") & num.rlike(r"[.]999$") & (F.col("kind") != "swap")})
    return t.withColumn("rest", _clean(F.col("exact"))).drop("_m", "num", "_c", "_d", "_around")


def fit_mixture(counts: DataFrame, units: dict[str, tuple[str, float]], rounds: int = 40) -> DataFrame:
    """EM of log10 magnitudes per group: each quantity has one shape (mu, sigma of log10 common units), and each
    unit of the catalog at each of SCALES is a component offset by its known factor.

    ``counts`` (g, q, code, scale, b, n) are rows summed by bin: code is '' where no unit is recorded, q too where
    no currency is, and scale is 0 where none is. Rows with a unit are labelled, those without even a currency
    are shared out by posterior. The groups
    are fitted side by side in the tasks; a group is as large as its bins, not as its rows. Returns rows of
    three kinds: 'shape' (q, mu, sigma), 'unit' (the likeliest code and scale of magnitude b with its
    posterior, for recorded scale ``told`` or 0) and 'doubt' (how likely magnitude b of q is in single common
    units, as against the quantity's other units and scales).
    """
    codes = sorted(units)

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        known, free = p[p["code"] != ""], p[(p["code"] == "") & (p["q"] == "")]
        quantities = sorted(set(known["q"]))
        comps = [(q, c, s, math.log10(units[c][1] * s)) for q in quantities for c in codes if units[c][0] == q for s in SCALES]
        none = pd.DataFrame([], columns=["g", "kind", "q", "told", "b", "code", "scale", "posterior", "mu", "sigma"])
        if not comps:
            return none
        g = p["g"].iloc[0]
        qi = np.array([quantities.index(q) for q, *_ in comps])
        off = np.array([o for *_, o in comps])
        of_scale = np.array([s for _, _, s, _ in comps])
        at = {(c, s): k for k, (_, c, s, _) in enumerate(comps)}
        share = np.full(len(comps), 0.5)
        s0, s1, s2 = (np.zeros(len(quantities)) for _ in range(3))
        for q, c, s, b, n in known[["q", "code", "scale", "b", "n"]].itertuples(index=False):
            x = b * BIN + math.log10(units[c][1] * (s or 1.0))
            j = quantities.index(q)
            s0[j] += n
            s1[j] += n * x
            s2[j] += n * x * x
            if (c, s or 1.0) in at:
                share[at[(c, s or 1.0)]] += n
        x, n, told = (free[k].to_numpy(float) for k in ("b", "n", "scale"))
        x = x * BIN
        allowed = (told[:, None] == 0) | (told[:, None] == of_scale[None, :])
        w, t0, t1, t2 = share.copy(), s0, s1, s2
        for _ in range(rounds if len(x) else 1):
            mu = t1 / t0
            sd = np.sqrt(np.maximum(t2 / t0 - mu * mu, 0.09))
            w = w / w.sum()
            if not len(x):
                break
            y = x[:, None] + off[None, :]
            dens = np.where(allowed, np.exp(-0.5 * ((y - mu[qi]) / sd[qi]) ** 2) / sd[qi] * w, 0.0) + 1e-300
            r = dens / dens.sum(axis=1, keepdims=True) * n[:, None]
            w = share + r.sum(axis=0)
            t0, t1, t2 = s0.copy(), s1.copy(), s2.copy()
            np.add.at(t0, qi, r.sum(axis=0))
            np.add.at(t1, qi, (r * y).sum(axis=0))
            np.add.at(t2, qi, (r * y * y).sum(axis=0))
        rows = [(g, "shape", q, 0.0, 0, "", 0.0, 0.0, float(mu[j]), float(sd[j])) for j, q in enumerate(quantities)]
        for b, s in sorted(set(zip(free["b"], free["scale"]))):
            d = np.exp(-0.5 * ((b * BIN + off - mu[qi]) / sd[qi]) ** 2) / sd[qi] * w * ((s == 0) | (of_scale == s)) + 1e-300
            k = int(np.argmax(d))
            rows.append((g, "unit", comps[k][0], float(s), int(b), comps[k][1], comps[k][2], float(d[k] / d.sum()), 0.0, 0.0))
        by_rule = p[(p["q"] != "") & p["q"].isin(quantities)]
        for q, b in sorted({(q, round((b * BIN + math.log10((units[c][1] if c else 1.0) * (s or 1.0))) / BIN)) for q, b, c, s in zip(by_rule["q"], by_rule["b"], by_rule["code"], by_rule["scale"])}):
            j = quantities.index(q)
            mine = qi == j
            d = np.exp(-0.5 * ((b * BIN + off[mine] - mu[j]) / sd[j]) ** 2) * w[mine] + 1e-300
            rows.append((g, "doubt", q, 0.0, int(b), "", 0.0, float(d[np.abs(off[mine]) < 1e-9].sum() / d.sum()), 0.0, 0.0))
        return pd.DataFrame(rows, columns=none.columns)

    return counts.groupBy("g").applyInPandas(fit, "g string, kind string, q string, told double, b int, code string, scale double, posterior double, mu double, sigma double")


def _bin(magnitude: Column) -> Column:
    return F.round(F.log10(F.when(magnitude > 0, magnitude)) / BIN).cast("int")


def normalize_units(items: DataFrame, catalog: DataFrame, group: str | None = None, uncertain_below: float = 0.9, doubt: bool = True) -> DataFrame:
    """Items with ``resolved_unit``, ``common_unit``, ``amount`` (decimal), ``amount_e4``, where unit and scale
    came from, ``unit_posterior`` (1 where the fields state both) and ``unit_uncertain``.

    Order of belief: what raw_value states, then unit, then scaling_factor; a missing unit is the currency's. A
    scale told in several places is one scale. Where not even a currency is recorded, the mixture's posterior
    assigns unit and scale (unit_source 'mixture'); where a full stop before three digits can group or be
    decimal, the posterior of the two readings decides. ``group`` names a column (a measure, a line item) whose
    values have magnitudes of their own. ``doubt``: whether rows by currency or without a scale get the
    mixture's posterior too.

    Texts are parsed once per distinct shape, not once per row; nothing of the items is written or shuffled.
    """
    made = {"common_unit", "amount", "amount_e4", "unit_source", "scale_source", "unit_posterior", "unit_uncertain", "resolved_unit"}
    keep = [c for c in items.columns if c not in made]
    spark = items.sparkSession
    cat = {r["unit_code"]: (r["common_unit"], float(r["factor"])) for r in bounded_rows(catalog.where("unit_code is not null and common_unit is not null and factor > 0").dropDuplicates(["unit_code"]), MOST_UNITS, "unit catalog")}
    exact = F.create_map(*[F.lit(x) for kv in EXACT_WORDS.items() for x in kv])
    base = _printed(items.select(*keep))
    both = F.explode(F.array(F.struct(F.lit(True).alias("raw"), F.col("_shape").alias("x")), F.struct(F.lit(False).alias("raw"), F.col("unit").alias("x")))).alias("p")
    texts = shared_checkpoint(base.select(both).where("p.x is not null").groupBy("p.raw", "p.x").count())
    shapes = parse_shapes(texts.where("raw").select(F.col("x").alias("shape"), "count"))
    forms = forms_table(spark, "f")
    told = shapes.join(F.broadcast(forms), F.col("rest") == F.col("f_text"), "left").withColumn("e", exact[F.col("exact")])
    told = shared_checkpoint(told.withColumn("ok", F.col("at").isNotNull() & ((F.col("rest") == "") | F.col("f_text").isNotNull() | F.col("e").isNotNull())).select("shape", "count", "at", "len", "take", "give", "take0", "give0", "lone", "negative", "groups", "decimals", "ok", F.when(F.col("ok"), F.coalesce("e", "f_code")).alias("_rc"), F.when(F.col("ok"), F.col("f_scale")).alias("_raw_scale")))
    named = texts.where("not raw").select(F.col("x").alias("_unit"), _clean(F.col("x")).alias("u"), exact[F.trim("x")].alias("e"))
    named = named.join(F.broadcast(forms), F.col("u") == F.col("f_text"), "left").select("_unit", F.coalesce("e", "f_code").alias("_uc"), F.col("f_scale").alias("_unit_scale"))
    seen = told.agg(F.sum(F.when(F.col("groups"), F.col("count"))).alias("g"), F.sum(F.when(F.col("decimals"), F.col("count"))).alias("d")).first()
    dot_odds = math.log(((seen["g"] or 0) + 1) / ((seen["d"] or 0) + 1))

    # Lookups are joins, not literals: the code of the stage stays small enough for the JVM to compile.
    codes = [(k, k, q, f) for k, (q, f) in cat.items()] + [(f"MINOR {c}", m, *cat[m]) for c, m in MINOR_OF.items() if m in cat]
    listed = F.broadcast(spark.createDataFrame(codes, "_key string, _code string, common_unit string, _factor double"))
    j = base.join(broadcast_if_small(told.select(F.col("shape").alias("_shape"), "at", "len", "take", "give", "take0", "give0", "lone", "negative", "ok", "_rc", "_raw_scale"), SMALL_FORMS), "_shape", "left")
    j = j.join(broadcast_if_small(named, SMALL_FORMS), F.col("unit") == F.col("_unit"), "left")
    j = j.withColumn("_own", F.coalesce("_rc", "_uc", "currency"))
    j = j.withColumn("_own", F.when(F.col("_own") == "MINOR", F.when(F.col("currency").isin(list(MINOR_OF)), F.concat(F.lit("MINOR "), "currency")).otherwise("USc")).otherwise(F.col("_own")))
    j = j.join(listed, F.col("_own") == F.col("_key"), "left").withColumn("resolved_unit", F.coalesce("_code", "_own"))
    sf = F.when(F.col("scaling_factor") > 0, F.col("scaling_factor"))
    told_twice = F.coalesce((F.col("_factor") < 1) & (F.abs(sf / F.col("_factor") - 1) < 1e-9), F.lit(False))
    j = j.withColumn("_told", F.coalesce("_raw_scale", "_unit_scale", F.when(~told_twice, sf)))
    j = j.withColumn("_digits", F.when(F.col("ok"), F.substring("_s", F.col("at"), F.col("len"))))
    j = j.withColumn("_zero", F.startswith(F.col("_digits"), F.lit("0")))
    text = F.expr("translate(_digits, if(_zero, take0, take), if(_zero, give0, give))")
    j = j.withColumns({"_dec": text.try_cast(DEC), "_grp": F.when(F.col("lone") & ~F.col("_zero"), F.translate("_digits", ".", "").try_cast(DEC)), "_raw_first": F.col("_rc").isNotNull() | F.col("_raw_scale").isNotNull(), "_value": F.when(~F.isnan("value"), F.col("value").try_cast(DEC))})
    j = j.withColumn("_raw_first", F.coalesce("_raw_first", F.lit(False)) | F.col("_value").isNull())
    own_group = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    j = j.withColumn("_g", own_group)

    # The mixture, from all rows whose number has one reading.
    j = j.withColumn("_b", _bin(F.abs(F.when(F.col("_raw_first"), F.col("_dec")).otherwise(F.col("_value")).cast("double"))))
    train = j.where("_grp is null and _b is not null and (common_unit is not null or resolved_unit is null)").select(F.col("_g").alias("g"), F.coalesce("common_unit", F.lit("")).alias("q"), F.when(F.col("common_unit").isNotNull() & (F.col("_rc").isNotNull() | F.col("_uc").isNotNull()), F.col("resolved_unit")).otherwise("").alias("code"), F.coalesce("_told", F.lit(0.0)).alias("scale"), F.col("_b").alias("b"))
    mix = shared_checkpoint(fit_mixture(train.groupBy("g", "q", "code", "scale", "b").agg(F.count("*").alias("n")), cat))
    shape = mix.where("kind = 'shape'").select(F.col("g").alias("_sg"), F.col("q").alias("_sq"), "mu", "sigma")
    unit = mix.where("kind = 'unit'").join(F.broadcast(listed.select("_key", F.col("common_unit").alias("_ucommon"), F.col("_factor").alias("_ufactor"))), F.col("code") == F.col("_key"))
    unit = unit.select(F.col("g").alias("_ug"), F.col("told").alias("_ut"), F.col("b").alias("_ub"), F.col("code").alias("_ucode"), F.col("scale").alias("_uscale"), F.col("posterior").alias("_upost"), "_ucommon", "_ufactor")
    j = j.withColumn("_lost", F.when(F.col("resolved_unit").isNull(), F.col("_b")))
    j = j.join(broadcast_if_small(unit, SMALL_FORMS), (F.col("_lost") == F.col("_ub")) & (F.col("_g") == F.col("_ug")) & (F.coalesce("_told", F.lit(0.0)) == F.col("_ut")), "left")
    j = j.withColumns({
        "unit_source": F.when(F.col("_rc").isNotNull(), "raw_value").when(F.col("_uc").isNotNull(), "unit").when(F.col("currency").isNotNull(), "currency").when(F.col("_ucode").isNotNull(), "mixture").otherwise("none"),
        "scale_source": F.when(F.col("_raw_scale").isNotNull(), "raw_value").when(F.col("_unit_scale").isNotNull(), "unit").when(F.col("scaling_factor") > 0, "scaling_factor").when(F.col("_uscale").isNotNull(), "mixture").otherwise("none"),
        "resolved_unit": F.coalesce("resolved_unit", "_ucode"), "_factor": F.coalesce("_factor", "_ufactor"), "common_unit": F.coalesce("common_unit", "_ucommon"), "_scale": F.coalesce("_told", "_uscale", F.lit(1.0)),
    })
    # A lone full stop: the value tells the reading where it fits only one; else the posterior of both does.
    j = j.withColumns({"_v": F.abs("_value").cast("double"), "_d": F.when(F.col("_grp").isNotNull(), F.col("_dec").cast("double")), "_full": F.col("_scale") * F.col("_factor")})
    j = j.withColumns({"_is_grp": F.coalesce(F.abs(F.col("_v") - 1000 * F.col("_d")) < 1e-6, F.lit(False)), "_is_dec": F.coalesce((F.abs(F.col("_v") - F.col("_d")) < 1e-6) | (F.abs(F.col("_v") - F.col("_d") * F.col("_scale")) < 1e-6), F.lit(False))})
    j = j.join(broadcast_if_small(shape, SMALL_FORMS), (F.when(F.col("_d").isNotNull() & (F.col("_is_grp") == F.col("_is_dec")), F.col("common_unit")) == F.col("_sq")) & (F.col("_g") == F.col("_sg")), "left")
    j = j.withColumn("_z", (F.log10(F.when(F.col("_d") > 0, F.col("_d") * F.col("_full"))) - F.col("mu")) / F.col("sigma"))
    # The readings lie three decades apart: log density of the grouped one over the decimal one.
    ratio = F.coalesce(-3 / F.col("sigma") * F.col("_z") - 4.5 / (F.col("sigma") * F.col("sigma")), F.lit(0.0))
    j = j.withColumn("_dot", F.when(F.col("_d").isNotNull(), F.when(F.col("_is_grp") & ~F.col("_is_dec"), F.lit(1.0)).when(F.col("_is_dec") & ~F.col("_is_grp"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.lit(dot_odds) - ratio)))))
    j = j.withColumn("_read", F.when(F.col("_dot") >= 0.5, F.col("_grp")).otherwise(F.col("_dec")))
    # A value that is the decimal reading already scaled is the printed number, not one to scale again.
    already = F.coalesce((F.col("_dot") < 0.5) & (F.abs(F.col("_v") - F.col("_d")) >= 1e-6), F.lit(False))
    number = F.when(F.col("_raw_first") & F.col("ok") | already, F.when(F.col("negative"), -F.col("_read")).otherwise(F.col("_read"))).otherwise(F.col("_value"))
    amount = F.try_multiply(number, (F.col("_scale").cast("decimal(16,4)") * F.col("_factor").cast("decimal(12,4)")).cast("decimal(20,6)"))
    j = j.withColumn("amount", F.when(F.col("common_unit").isNotNull(), amount))
    j = j.withColumn("amount_e4", F.round(F.try_multiply(F.col("amount"), F.lit(10000).cast("decimal(6,0)")), 0).try_cast("bigint"))
    sure = F.when(F.col("amount").isNotNull(), F.coalesce("_upost", F.greatest("_dot", 1 - F.col("_dot")), F.lit(1.0)))
    if doubt:
        unsaid = F.col("unit_source").isin("currency") | (F.col("scale_source") == "none")
        d = mix.where("kind = 'doubt'").select(F.col("g").alias("_dg"), F.col("q").alias("_dq"), F.col("b").alias("_db"), F.col("posterior").alias("_dp"))
        j = j.withColumn("_at", F.when(unsaid, _bin(F.abs(F.col("amount").cast("double")))))
        j = j.join(broadcast_if_small(d, SMALL_FORMS), (F.col("_at") == F.col("_db")) & (F.col("common_unit") == F.col("_dq")) & (F.col("_g") == F.col("_dg")), "left")
        sure = F.when(F.col("amount").isNotNull(), F.coalesce("_upost", "_dp", F.greatest("_dot", 1 - F.col("_dot")), F.lit(1.0)))
    j = j.withColumn("unit_posterior", sure).withColumn("unit_uncertain", F.col("unit_posterior") < uncertain_below)
    return j.select(*keep, "resolved_unit", "common_unit", "amount", "amount_e4", "unit_source", "scale_source", "unit_posterior", "unit_uncertain")


def unit_repairs(items: DataFrame, catalog: DataFrame, group: str | None = None) -> DataFrame:
    """item_id, common_unit, common_e4 of items whose recorded fields do not already give the amount."""
    own = ["item_id", "currency", "value", "raw_value", "unit", "scaling_factor"]
    n = normalize_units(items.select(*dict.fromkeys([*own, *([group] if group else [])])), catalog, group, doubt=False)
    given = F.col("value") * F.coalesce("scaling_factor", F.lit(1.0)) * 10000
    # Equal to within half a unit and what doubles of this size can hold.
    same = F.coalesce((F.col("unit") == F.col("common_unit")) & (F.abs(given - F.col("amount_e4")) < 0.5 + 4e-16 * F.abs(given)), F.lit(False))
    # The partition's number keeps the filter above the projection: pushed below, it would compute each amount twice.
    n = n.withColumn("_here", F.spark_partition_id())
    return n.where((F.col("_here") >= 0) & F.col("amount_e4").isNotNull() & ~same).select("item_id", "common_unit", F.col("amount_e4").alias("common_e4")).distinct()

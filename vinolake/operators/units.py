"""Quantities in different units: dynamic programming over tries of prefixes, roots and exponents.

``segment(unit, field)`` decomposes a unit string such as ``cl``, ``hl``,
``cm3`` or ``fl.oz.`` into prefix + root + exponent. All decompositions are
scored by the log-weight of their parts plus the log-prior of the resulting
dimension in the field the string came from, so ``m`` after a number in a bottle
title is a length and never a volume, while ``min`` is a time, not a milli-inch.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinolake.functions.glyphs import skeleton
from vinolake.operators.scale import small_side

# SI prefixes, roots with their dimension and size in the base unit
# (ml, m, g, m2, s, euro, bottle), and exponents.
PREFIXES = {"": 1.0, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "kilo": 1e3, "hecto": 1e2, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3}
ROOTS = {
    "l": ("volume", 1000.0), "lt": ("volume", 1000.0), "ltr": ("volume", 1000.0), "liter": ("volume", 1000.0), "litre": ("volume", 1000.0), "liters": ("volume", 1000.0), "litres": ("volume", 1000.0), "litro": ("volume", 1000.0),
    "floz": ("volume", 29.5735), "pint": ("volume", 473.176), "gal": ("volume", 3785.41), "cc": ("volume", 1.0),
    "m": ("length", 1.0), "metre": ("length", 1.0), "meter": ("length", 1.0), "in": ("length", 0.0254), "ft": ("length", 0.3048),
    "g": ("mass", 1.0), "gr": ("mass", 1.0), "gram": ("mass", 1.0), "gramme": ("mass", 1.0), "oz": ("mass", 28.3495), "lb": ("mass", 453.592),
    "a": ("area", 100.0), "are": ("area", 100.0), "ha": ("area", 10000.0),
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "mois": ("time", 2.6e6), "an": ("time", 3.2e7), "ans": ("time", 3.2e7), "jahre": ("time", 3.2e7), "jaar": ("time", 3.2e7),
    "eur": ("money", 1.0), "euro": ("money", 1.0), "€": ("money", 1.0), "ct": ("money", 0.01), "cent": ("money", 0.01), "cents": ("money", 0.01), "centime": ("money", 0.01), "centimes": ("money", 0.01), "eurocent": ("money", 0.01), "c": ("money", 0.01), "minorunits": ("money", 0.01), "minorunit": ("money", 0.01),
    "bt": ("bottle", 1.0), "btl": ("bottle", 1.0), "bottle": ("bottle", 1.0), "bottles": ("bottle", 1.0), "fles": ("bottle", 1.0), "flessen": ("bottle", 1.0), "flasche": ("bottle", 1.0), "flaschen": ("bottle", 1.0), "bouteille": ("bottle", 1.0), "bouteilles": ("bottle", 1.0), "magnum": ("bottle", 2.0),
}
EXPONENTS = {"": 1, "2": 2, "3": 3, "²": 2, "³": 3}
#: P(dimension | field).
PRIORS = {
    "bottle_text": {"volume": 0.9, "length": 0.03, "area": 0.02, "time": 0.02, "mass": 0.01, "bottle": 0.02},
    "price_basis": {"money": 0.45, "volume": 0.35, "bottle": 0.19, "mass": 0.001, "length": 0.001, "area": 0.001, "time": 0.001},
}
NAMED_ML = {"double magnum": 3000, "jeroboam": 3000, "magnum": 1500, "mag": 1500, "clavelin": 620, "demi-bouteille": 375, "demi bouteille": 375, "demie": 375, "half bottle": 375, "halbe flasche": 375, "halve fles": 375}
COUNT_WORDS = {"six": 6, "sechs": 6, "zes": 6, "trois": 3, "drei": 3, "drie": 3, "three": 3, "douze": 12, "twelve": 12}
BOX_WORDS = "carton|karton|kartons|doos|caisse|case|box|kiste|coffret|pack"
# End of fixed values.

#: A stated volume outside these bounds (ml) is not a bottle's.
BOTTLE_ML = (90.0, 30_000.0)


def _trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node["$"] = w
    return root


_P, _R, _E = _trie(PREFIXES), _trie(ROOTS), _trie(EXPONENTS)


def _matches(trie: dict, s: str, i: int):
    """Every entry of ``trie`` that starts at ``s[i]``, with the position after it."""
    node = trie
    if "$" in node:
        yield "", i
    while i < len(s) and s[i] in node:
        node, i = node[s[i]], i + 1
        if "$" in node:
            yield node["$"], i


@lru_cache(maxsize=50_000)
def segment(unit: str, field: str) -> tuple[str, float] | None:
    """(dimension, size in base units) of the best decomposition of a whole unit string, or None.

    best[i][stage] is the best score of a parse of unit[:i] whose last part was a
    prefix (1), a root (2) or an exponent (3).
    """
    unit = re.sub(r"[\s.]+", "", unit)
    prior = PRIORS[field]
    best: dict[tuple[int, int], tuple[float, float, str, float]] = {(0, 0): (0.0, 1.0, "", 1.0)}
    for i in range(len(unit) + 1):
        if (i, 0) in best:
            for w, j in _matches(_P, unit, i):
                cost = 0.0 if w == "" else -1.0 if len(w) == 1 else -0.5
                _keep(best, (j, 1), (cost, PREFIXES[w], "", 1.0))
        if (i, 1) in best:
            score, factor, _, _ = best[i, 1]
            for w, j in _matches(_R, unit, i):
                dim, base = ROOTS[w]
                if factor != 1.0 and (dim in ("money", "bottle", "time") or w in ("ft", "in", "lb", "pint", "gal", "floz", "cc")):
                    continue
                _keep(best, (j, 2), (score + math.log(prior.get(dim, 1e-4)) + 0.2 * len(w), factor, dim, base))
        if (i, 2) in best:
            score, factor, dim, base = best[i, 2]
            for w, j in _matches(_E, unit, i):
                e = EXPONENTS[w]
                if e > 1 and dim != "length":
                    continue
                size = (factor * base) ** e
                kind = {1: dim, 2: "area", 3: "volume"}[e]
                if e > 1:
                    score += math.log(prior.get(kind, 1e-4)) - math.log(prior.get(dim, 1e-4))
                _keep(best, (j, 3), (score, size * (1e6 if e == 3 else 1.0), kind, 1.0))
    end = best.get((len(unit), 3))
    return (end[2], end[1]) if end and unit else None


def _keep(best: dict, at: tuple[int, int], found: tuple) -> None:
    if at not in best or best[at][0] < found[0]:
        best[at] = found


_QUANTITY = re.compile(r"(?<![\w.,'’°])(?:\d{1,2}\s*x\s*)?(\d{1,5}(?:[.,]\d{1,3})?)\s*(fl\.?\s*oz|[a-z]{1,12}[23²³]?)(?![a-z])")
_NAMED = re.compile("|".join(rf"(?<![a-z]){re.escape(w)}(?![a-z])" for w in sorted(NAMED_ML, key=len, reverse=True)))


def bottle_ml(text: str | None) -> float | None:
    """The volume in ml of one bottle that a title states by number and unit, else by a named format; null if none.

    Of several stated volumes the last counts (marketing comes first, the format last).
    """
    return skeleton_ml(skeleton(text))


def skeleton_ml(s: str) -> float | None:
    """``bottle_ml`` of a text that is a skeleton already."""
    if not s:
        return None
    found = None
    for m in _QUANTITY.finditer(s):
        unit = segment(m.group(2), "bottle_text")
        if unit and unit[0] == "volume":
            ml = float(m.group(1).replace(",", ".")) * unit[1]
            if BOTTLE_ML[0] <= ml <= BOTTLE_ML[1]:
                found = ml
    if found is None:
        for m in _NAMED.finditer(s):
            found = float(NAMED_ML[m.group(0)])
    return found


_PRICE_TOKEN = re.compile(r"\d+(?:[.,]\d+)?|[a-z€]+")


@lru_cache(maxsize=50_000)
def price_basis(text: str | None) -> tuple[float, float] | None:
    """(euro per unit of the number, ml the price is for) of a price-basis text in free words, or None if it says nothing.

    Numbers are taken with the unit after them; a number beside a box word, or a
    count word, is a number of bottles; a bare number that belongs to neither
    (an example such as "3900 means 39,00") is ignored.
    """
    s = skeleton(text)
    if not s:
        return None
    s = re.sub(r"minor\s+units?", "minorunits", s)
    money = volume = None
    bottles = 1.0
    boxed = re.search(rf"(?<![a-z])({BOX_WORDS})(?![a-z])", s) is not None
    tokens = _PRICE_TOKEN.findall(s)
    for k, tok in enumerate(tokens):
        after = tokens[k + 1] if k + 1 < len(tokens) else ""
        if tok[0].isdigit():
            n = float(tok.replace(",", "."))
            unit = segment(after, "price_basis") if after else None
            if tok == "100" and k and tokens[k - 1] == "x" or tok == "100" and after == "" and k and tokens[k - 1].endswith("x"):
                money = 0.01
            elif unit and unit[0] == "volume":
                volume = n * unit[1]
            elif after == "x":
                bottles = n
            elif boxed and n <= 24 and n == int(n):
                bottles = n
            continue
        if tok in COUNT_WORDS:
            bottles = float(COUNT_WORDS[tok])
            continue
        unit = segment(tok, "price_basis") or segment(re.sub(r"(preis|price|prijs)$", "", tok), "price_basis")
        if unit is None:
            continue
        before = tokens[k - 1] if k else ""
        if unit[0] == "money":
            money = min(money or unit[1], unit[1])
        elif unit[0] == "volume" and not before[:1].isdigit():
            volume = unit[1]
        elif unit[0] == "bottle" and volume is None:
            volume = 750.0 * unit[1]
    if volume is None and bottles == 1.0 and money is None:
        return None
    return (money or 1.0, (volume or 750.0) * bottles)


def with_bottle_volume(df: DataFrame, columns: list[str], to: str = "bottle_ml") -> DataFrame:
    """Adds the bottle volume in ml that the text columns state; of several columns the last one that states any counts.

    Null and empty texts state nothing; a column named ``to`` is replaced. One
    narrow pass in Arrow batches, no shuffle.
    """

    @F.pandas_udf(T.DoubleType())
    def stated(*texts: pd.Series) -> pd.Series:
        rows = zip(*[t.tolist() for t in texts])
        return pd.Series([next((ml for x in reversed(r) if (ml := bottle_ml(x)) is not None), None) for r in rows], dtype="float64")

    return df.withColumn(to, stated(*[F.col(f"`{c}`") for c in columns]))


def with_price_basis(df: DataFrame, basis: str, to: str = "basis") -> DataFrame:
    """Adds struct(euro, ml): what one unit of the recorded number is worth, and the volume it is for. Null if unstated."""

    @F.pandas_udf("euro double, ml double")
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([price_basis(x) or (None, None) for x in text.tolist()], columns=["euro", "ml"], dtype="float64")

    return df.withColumn(to, parse(F.col(f"`{basis}`")))


def found_amounts(listing: DataFrame, observation: DataFrame, shops: DataFrame) -> DataFrame:
    """Distinct (source, record_id, amount): stated bottle volumes in ml (to 5), and prices not recorded in euro per 75 cl, in cents per 75 cl.

    Rows with a null id, price or basis, and texts without a statement, give nothing.
    """
    volumes = (
        with_bottle_volume(listing.select("listing_id", "title", "variant_title"), ["title", "variant_title"])
        .where("bottle_ml is not null and listing_id is not null")
        .select(F.lit("listing").alias("source"), F.col("listing_id").alias("record_id"), (F.round(F.col("bottle_ml") / 5) * 5).cast("long").alias("amount"))
    )
    basis = shops.groupBy("shop").agg(F.max("price_basis").alias("price_basis"))
    prices = (
        with_price_basis(
            observation.select("obs_id", "shop", "price750", "price_unit")
            .where("obs_id is not null and price750 is not null")
            .join(small_side(basis), "shop", "left")
            .withColumn("basis_text", F.coalesce(F.when(F.trim("price_unit") != "", F.col("price_unit")), F.col("price_basis"))),
            "basis_text",
        )
        .where("basis.euro is not null and not (basis.euro = 1 and abs(basis.ml - 750) < 5)")
        .select(F.lit("observation").alias("source"), F.col("obs_id").alias("record_id"), F.round(F.col("price750") * F.col("basis.euro") * 100 * 750 / F.col("basis.ml"), 0).cast("long").alias("amount"))
    )
    return volumes.unionByName(prices).distinct()

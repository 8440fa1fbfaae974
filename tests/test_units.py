
import pytest

from vinolake.operators.units import bottle_ml, found_amounts, price_basis, segment


@pytest.mark.parametrize(
    "unit,field,kind,size",
    [
        ("cl", "bottle_text", "volume", 10), ("ml", "bottle_text", "volume", 1), ("centilitres", "bottle_text", "volume", 10), ("fl. oz.", "bottle_text", "volume", 29.5735), ("cm3", "bottle_text", "volume", 1),
        ("dm3", "bottle_text", "volume", 1000), ("m", "bottle_text", "length", 1), ("ha", "bottle_text", "area", 10000), ("min", "bottle_text", "time", 60), ("ct", "price_basis", "money", 0.01), ("eurocent", "price_basis", "money", 0.01),
    ],
)
def test_segment(unit, field, kind, size):
    assert segment(unit, field)[0] == kind
    assert segment(unit, field)[1] == pytest.approx(size)


@pytest.mark.parametrize("unit", ["ex", "vol", "", "clx", "zz"])
def test_segment_none(unit):
    assert segment(unit, "bottle_text") is None


@pytest.mark.parametrize(
    "text,ml",
    [
        ("Clos X 2015 75cl", 750), ("0,75 L", 750), ("25.4 fl. oz.", 751), ("6x75cl", 750), ("6 x 0,75 L", 750), ("magnum", 1500), ("Double Magnum 3L", 3000), ("double magnum", 3000), ("clavelin", 620), ("2015 / demie", 375), ("half bottle", 375),
        ("Rosé 300 m d'altitude", None), ("750 m", None), ("vigne de 1,5 ha", None), ("12,5% vol", None), ("tirage 1500 ex.", None), ("élevé 18 mois", None), ("coffret 3 bouteilles", None), ("lot 75 L. Dupont", None), ("2018 L. Dupont", None),
        ("７５ cl", 750), ("75 cl", 750), ("7​5 cl", 750), ("75 сl", 750), (None, None), ("", None), ("x" * 200_000 + " 75cl", 750),
    ],
)
def test_bottle(text, ml):
    assert bottle_ml(text) == (None if ml is None else pytest.approx(ml, abs=2))


@pytest.mark.parametrize(
    "text,basis",
    [
        ("EUR/75cl", (1, 750)), ("prix au litre", (1, 1000)), ("6er Karton", (1, 4500)), ("EUR x100", (0.01, 750)), ("feed gives minor units: 3900 means 39,00", (0.01, 750)), ("montants en centimes, bouteille 75 cl", (0.01, 750)),
        ("EUR/magnum", (1, 1500)), ("per 150cl", (1, 1500)), ("prijs per doos van 6 flessen", (1, 4500)), ("Literpreis in Euro", (1, 1000)), (None, None), ("call us", None),
    ],
)
def test_price_basis(text, basis):
    assert price_basis(text) == basis


def test_found_amounts(spark):
    listing = spark.createDataFrame([(1, "X 75cl", None, "n"), (1, "X 75cl", None, "n"), (2, None, "Magnum", "n"), (3, "no size", "", "n"), (None, "75cl", None, "n")], "listing_id bigint, title string, variant_title string, source string")
    obs = spark.createDataFrame([(7, "a", 40.0, "prix au litre"), (8, "b", 12.0, None), (9, "a", 10.0, None), (10, "a", None, "ct"), (11, "zz", 1.0, None)], "obs_id bigint, shop string, price750 double, price_unit string")
    shops = spark.createDataFrame([("a", "EUR/75cl"), ("b", "tarif au carton de six")], "shop string, price_basis string")
    assert {tuple(r) for r in found_amounts(listing, obs, shops).collect()} == {("listing", 1, 750), ("listing", 2, 1500), ("observation", 7, 3000), ("observation", 8, 200)}
    assert found_amounts(listing.limit(0), obs.limit(0), shops.limit(0)).count() == 0

import pytest
from pyspark.sql import functions as F

from pressmill.operators import units

RATES = [("usd", "lkr", 312), ("gbp", "lkr", 396), ("acre", "perch", 160), ("rood", "perch", 40)]
PRICES = "price_id string, provider string, raw string, amount bigint, note string"


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame(RATES, "unit_code string, common_unit string, factor bigint")


CASES = [
    ("Rs. 1,450,000.00", 1450000), ("rs 30,000 upwards", 30000), ("37k", 37000), ("Rs. 40.5 lakhs", 4050000), ("109.5 lks", 10950000), ("1.41L", 141000),
    ("ලක්ෂ 241", 24100000), ("දහස් 5700", 5700000), ("16.5 மில்லியன்", 16500000), ("5.2 லட்சம்", 520000), ("Rs 22.7 mil.", 22700000), ("3.95M", 3950000),
    ("Rs 1.7 crores", 17000000), ("US$ 80", 24960), ("GBP 32,070", 12699720), ("£ 10", 3960), ("Rs. 420,000 p.a.", 35000), ("10.2k monthly", 10200),
    ("Rs. 63,200,000 / rood", 1580000), ("345.6 million per acre", 2160000), ("පර්චසය රු. 1,120,000", 1120000), ("thirty two lakhs only", 3200000),
    ("Rs. 12,OOO", 12000), ("Rs. 1,18O,OOO", 1180000), ("Rs. 4100000/-", 4100000), ("Rs. 12 thousnad", 12000), ("7 lakkhs", 700000), ("Ｒｓ． ５００", 500),
    ("one hundred twenty five lakhs", 12500000), ("two lakhs fifty thousand", 250000), ("Rs. 1 lakh 50 thousand", 150000), ("2 crores 5 lakhs 30,000", 20530000),
    ("Rs. 5 lakhs 2 perches", 250000 * 2), ("hundred thousand only", 100000), ("Rs. 5,000 or 6,000", 5000), ("three million two hundred thousand and forty", 3200040),
    ("US$ 1 thousand 50", 327600), ("two hundred", 200),
]


def test_printed_forms(spark, rates):
    rows = [(f"p{i}", "x", raw, None, "n") for i, (raw, _) in enumerate(CASES)]
    got = {r.raw: (r.amount_common, r.basis) for r in units.to_common_units(spark.createDataFrame(rows, PRICES), rates).collect()}
    assert {raw: got[raw] for raw, _ in CASES} == {raw: (value, "raw") for raw, value in CASES}


def test_provider_units_and_nulls(spark, rates):
    rows = [(f"d{i}", "desk", f"Rs. {i},000", i * 100000, "n") for i in range(1, 8)]
    rows += [("d8", "desk", None, 250000, "n"), ("d9", "desk", "Call for price", 300, "n"), ("x1", "other", None, 77, "n"), ("x2", "other", "", None, "n"), ("x3", None, None, 5, "n"), ("d8", "desk", None, 250000, "n")]
    done = units.to_common_units(spark.createDataFrame(rows, PRICES), rates)
    got = {r.price_id: (r.amount_common, r.basis) for r in done.collect()}
    assert got["d8"] == (2500, "provider") and got["d9"] == (3, "provider")
    assert got["x1"] == (77, "amount") and got["x2"] == (None, None) and got["x3"] == (5, "amount")
    assert done.count() == len(rows) and "note" in done.columns
    wrong = units.wrong_amounts(spark.createDataFrame(rows, PRICES), rates)
    assert wrong.where("price_id = 'd8'").count() == 1 and wrong.where("price_id = 'x1'").count() == 0


def test_empty_and_long(spark, rates):
    assert units.wrong_amounts(spark.createDataFrame([], PRICES), rates).count() == 0
    rows = [("a", "x", "Rs. " + "very " * 20000 + "5", None, "n")]
    assert units.wrong_amounts(spark.createDataFrame(rows, PRICES), rates).collect()[0].amount_lkr == 5


def test_index_finds_what_brute_force_finds(spark):
    words = ["thousand", "thousnd", "lakhs", "lakkhs", "millon", "perche", "crroes", "abcdef", "negotiabel", "yearly"]
    got = {r.token: r.concept for r in units.alias_dictionary(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    known = units.alias_rows()
    for w in words:
        near = sorted((units.weighted_distance(w, a), a, c) for a, c in known if len(a) >= 4 and units.weighted_distance(w, a) <= 0.25 * max(len(a), len(w)))
        assert got.get(w) == (near[0][2] if near else None), w


def test_misread_zero(spark):
    got = spark.range(1).select(units.printed(F.lit("Rs. 1O,9OO,OOO Only")).alias("t")).collect()[0].t
    assert got == "rs. 10,900,000 only"

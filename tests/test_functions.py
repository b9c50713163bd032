import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from starcast.functions import attributes as a
from starcast.functions import text as t
from starcast.functions.numeric import clip, ensemble_mean, half_stars


def values(spark, kind, inputs, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(build(F.col("v")).alias("x")).collect()]


def test_categories(spark):
    assert values(spark, "string", ["A, B", "", None, "A"], t.split_categories) == [["A", "B"], [""], [], ["A"]]
    kept = values(spark, "string", ["A, B, A", "", None, "Z"], lambda c: t.keep_top(t.split_categories(c), ["A", "C"]))
    assert kept == [["A"], [], [], []]


def test_friends_and_elite(spark):
    texts = ["None", "u1", "u1, u2, u1"]
    assert values(spark, "string", texts, t.friend_list) == [[], ["u1"], ["u1", "u2"]]
    assert values(spark, "string", texts, t.friend_count) == [0, 1, 3]
    assert values(spark, "string", ["None", "2015", "2015, 2016"], t.elite_count) == [0, 1, 2]


def test_start_year(spark):
    assert values(spark, "string", ["2012-05-01", "1999"], t.start_year) == [2012, 1999]
    assert values(spark, "string", ["junk", None], lambda c: t.start_year(c, strict=False)) == [None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, "string", ["junk"], t.start_year)


def test_postal_code_point(spark):
    assert values(spark, "string", ["8901", "", None, "É1"], t.postal_code_point) == [ord("8"), None, None, ord("É")]


def test_days_open(spark):
    assert values(spark, "map<string,string>", [{"Mon": "9"}, {}, None], a.days_open) == [1, None, None]


MAPS = [
    {"RestaurantsPriceRange2": "3", "NoiseLevel": "very_loud", "Alcohol": "none", "DriveThru": "True"},
    {"NoiseLevel": "", "Alcohol": "full_bar", "DriveThru": "False", "GoodForKids": "maybe"},
    {},
    None,
]


@pytest.mark.parametrize(
    "build, expected",
    [
        (a.price_range, [3, None, None, None]),
        (a.price_range_default2, [3, 2, 2, None]),
        (a.noise_code, [3, None, None, None]),
        (a.alcohol_flag, [0, 1, None, None]),
        (lambda c: a.true_false_flag(c, a.DRIVE_THRU_KEY), [1, 0, None, None]),
        (lambda c: a.true_false_flag(c, a.KIDS_KEY), [None, None, None, None]),
        (lambda c: a.lookup(c, "Alcohol", "?"), ["none", "full_bar", "?", None]),
    ],
)
def test_attributes(spark, build, expected):
    assert values(spark, "map<string,string>", MAPS, build) == expected


def test_noise_codes_follow_the_alphabet(spark):
    labels = ["average", "loud", "quiet", "very_loud"]
    assert values(spark, "map<string,string>", [{"NoiseLevel": n} for n in labels], a.noise_code) == [0, 1, 2, 3]
    defaulted = values(spark, "map<string,string>", [{}, {"NoiseLevel": "quiet"}, None], a.noise_code_default_average)
    assert defaulted == [0, 2, None]


def test_unknown_label(spark):
    odd = [{"NoiseLevel": "deafening"}]
    assert values(spark, "map<string,string>", odd, lambda c: a.noise_code(c, "null")) == [None]
    with pytest.raises(Exception, match="unknown noise level: deafening"):
        values(spark, "map<string,string>", odd, a.noise_code)
    with pytest.raises(ValueError):
        a.noise_code(F.col("v"), "ignore")


def test_numbers(spark):
    assert values(spark, "double", [0.5, 5.5, 3.0, None], clip) == [1.0, 5.0, 3.0, None]
    assert values(spark, "double", [1.0, 4.0], lambda c: ensemble_mean(c, F.lit(2.0), F.lit(3.0))) == [2.0, 3.0]
    assert values(spark, "double", [1.0, 4.5, None], half_stars) == [2, 9, None]
    with pytest.raises(Exception, match="not a multiple"):
        values(spark, "double", [1.3], half_stars)

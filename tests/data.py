"""Hand rows with the awkward cases: missing maps and texts, unseen ids, repeated ratings."""

from starcast.schemas import BUSINESS, USER

USERS = [
    dict(user_id="u1", name="A", review_count=4, yelping_since="2010-01-01", friends="u2, u3, u2", useful=7,
         elite="2011, 2012", average_stars=3.5),
    dict(user_id="u2", name="B", review_count=1, yelping_since="2012-07-01", friends="None", useful=0, elite="None",
         average_stars=2.0),
    dict(user_id="u3", name="C", review_count=9, yelping_since="2015-03-01", friends="u1", useful=2, elite="2016",
         average_stars=4.0),
    dict(user_id="idle", name="D", review_count=3, yelping_since="2011-03-01", friends="u1", useful=2, elite="None",
         average_stars=1.0),
]
BUSINESSES = [
    dict(business_id="b1", name="X", state="NV", postal_code="89101", latitude=1.0, longitude=2.0, stars=4.0,
         review_count=10, is_open=1, categories="Bars, Food",
         attributes={"RestaurantsPriceRange2": "3", "NoiseLevel": "loud", "Alcohol": "none", "DriveThru": "True",
                     "GoodForKids": "False"},
         hours={"Monday": "9:0-17:0", "Friday": "9:0-17:0"}),
    dict(business_id="b2", name="Y", state="AZ", postal_code="", stars=2.5, review_count=3, is_open=0, categories=None,
         attributes=None, hours=None),
    dict(business_id="b3", name="Z", state="NV", postal_code=None, stars=3.0, review_count=5, is_open=1,
         categories="Food, Golf", attributes={"Alcohol": "full_bar"}, hours={}),
    dict(business_id="unused", name="W", state="ON", postal_code="M5", stars=1.0, review_count=1, is_open=1,
         categories="Bars", attributes={}, hours=None),
]
# (user, business, stars, position)
RATINGS = [
    ("u1", "b1", 4.0, 1), ("u2", "b1", 3.0, 2), ("u2", "b1", 5.0, 3), ("u3", "b1", 2.0, 4), ("u1", "b2", 1.0, 5),
    ("u3", "b3", 5.0, 6), ("ghost", "b2", 3.0, 7), ("u2", "b3", 2.0, 8),
]
PAIRS = [("u1", "b3"), ("u2", "b2"), ("u1", "b1"), ("ghost", "b1"), ("u1", "new"), ("ghost", "new")]


def _frame(spark, rows, schema):
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema) for row in rows], schema)


def users(spark):
    return _frame(spark, USERS, USER)


def businesses(spark):
    return _frame(spark, BUSINESSES, BUSINESS)


def ratings(spark):
    return spark.createDataFrame(RATINGS, "user_id string, business_id string, stars double, n int")


def pairs(spark):
    return spark.createDataFrame(PAIRS, "user_id string, business_id string")

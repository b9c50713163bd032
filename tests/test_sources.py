import data
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from starcast.schemas import BUSINESS
from starcast.session import discard_intermediates, intermediates, materialize, materialize_measured, row_count, shared_dir
from starcast.sources import files, folders


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "ratings")
    data.ratings(spark).drop("n").write.option("header", True).csv(path)
    assert rows_of(files.read_ratings(spark, path)) == rows_of(data.ratings(spark).drop("n"))
    assert rows_of(files.read_truth(spark, path)) == rows_of(data.ratings(spark).drop("n"))


def test_pairs_ignore_the_third_field(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text("user_id,business_id,stars\nu1,b1,\nu2,b2,\n")
    assert rows_of(files.read_pairs(spark, str(path))) == [("u1", "b1"), ("u2", "b2")]


def test_bad_stars_raise(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("user_id,business_id,stars\nu1,b1,many\n")
    with pytest.raises(Exception, match="many|MALFORMED"):
        files.read_ratings(spark, str(path)).collect()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "business.json"
    path.write_text(
        '{"business_id": "b1", "attributes": {"WiFi": "no", "Parking": {"lot": true}}, "hours": null, "stars": 4.5}\n'
        '{"business_id": "b2", "attributes": null, "categories": "A, B"}\n'
    )
    first, second = files.read_businesses(spark, str(path)).orderBy("business_id").collect()
    assert first["attributes"] == {"WiFi": "no", "Parking": '{"lot": true}'} and first["stars"] == 4.5
    assert second["attributes"] is None and second["categories"] == "A, B"
    users = tmp_path / "user.json"
    users.write_text('{"user_id": "u1", "friends": "None", "compliment_hot": 3, "average_stars": 3.5}\n')
    assert files.read_users(spark, str(users)).first()["compliment_hot"] == 3


def test_predictions_round_trip(spark, tmp_path):
    predictions = spark.createDataFrame(
        [("u1", "b1", 3.25), ("u2", "b1", 4.0)], "user_id string, business_id string, prediction double"
    )
    path = str(tmp_path / "predictions")
    files.write_predictions(predictions, path)
    files.write_predictions(predictions, path)
    assert rows_of(files.read_predictions(spark, path)) == rows_of(predictions)


def test_written_tables(spark):
    df = spark.createDataFrame([(1, {"a": "b"}), (5, None)], "n long, m map<string,string>")
    written, measured = materialize_measured(df, "test", rows=row_count())
    assert measured == {"rows": 2} and written.schema == df.schema
    assert rows_of(written) == rows_of(df) == rows_of(materialize(df, "test"))
    assert written.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark).replace("file:", ""))
    assert BUSINESS["attributes"].dataType.valueType.simpleString() == "string"


def test_intermediates_can_be_discarded(spark):
    discard_intermediates(spark)
    written = materialize(spark.range(5), "test")
    assert written.count() == 5
    assert discard_intermediates(spark) == 1
    assert discard_intermediates(spark) == 0


@pytest.mark.parametrize(
    ("read", "text"),
    [
        (files.read_pairs, "user_id,business_id,stars\nu1,\n"),
        (files.read_pairs, "user_id,business_id,stars\nu1\n"),
        (files.read_ratings, "user_id,business_id,stars\nu1,b1,\n"),
        (files.read_ratings, "user_id,business_id,stars\n,b1,3\n"),
        (files.read_ratings, "business_id,user_id,stars\nb1,u1,3\n"),
        (files.read_truth, "user_id,business_id,stars\nu1,b1,\n"),
        (files.read_predictions, "user_id,business_id,prediction\nu1,,3\n"),
        (files.read_users, "not json at all\n"),
        (files.read_users, '{"user_id": "u1", "average_stars": "junk"}\n'),
        (files.read_users, '{"average_stars": 3.5}\n'),
        (files.read_businesses, '{"business_id": "b1", "stars": "junk"}\n'),
        (files.read_businesses, '{"business_id": "b1"\n'),
    ],
)
def test_bad_lines_are_errors(spark, tmp_path, read, text):
    path = tmp_path / "bad"
    path.write_text(text)
    with pytest.raises(Exception):
        read(spark, str(path)).collect()


def test_a_job_deletes_its_own_tables_only(spark):
    outer = materialize(spark.range(3), "outer")
    with intermediates(spark):
        inner = materialize(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_only_a_local_master_gets_a_folder_of_its_own(monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_rejected_lines(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    lines = ["u1,b1,4", "u2,b2,many", "u3,b3", ",b4,1", "u5,b5,", "u6,b6,2,extra", "u7,b7,5.0"]
    path.write_text("\n".join(["user_id,business_id,stars", *lines]) + "\n")
    found = files.read_ratings_or_rejects(spark, str(path))
    assert rows_of(found.good) == [("u1", "b1", 4.0), ("u7", "b7", 5.0)]
    reasons = {tuple(r) for r in found.rejected.select("reason", files.LINE).collect()}
    assert reasons == {("malformed", line) for line in (lines[1], lines[2], lines[5])} | {("no user_id", None), ("no stars", None)}
    assert (found.n_good, found.n_rejected) == (2, 5) and found.n_good + found.n_rejected == len(lines)


def test_rejected_json_lines(spark, tmp_path):
    path = tmp_path / "user.json"
    path.write_text('{"user_id": "u1", "average_stars": 3.5}\n{"user_id": \n{"average_stars": 1.0}\n')
    found = files.read_users_or_rejects(spark, str(path))
    assert [r["user_id"] for r in found.good.collect()] == ["u1"] and files.LINE not in found.good.columns
    assert sorted(r["reason"] for r in found.rejected.collect()) == ["malformed", "no user_id"]
    businesses = tmp_path / "business.json"
    businesses.write_text('{"business_id": "b1"}\n')
    assert files.read_businesses_or_rejects(spark, str(businesses)).n_rejected == 0


def test_a_failed_write_leaves_the_old_predictions(spark, tmp_path):
    schema = "user_id string, business_id string, prediction double"
    old, path = spark.createDataFrame([("u1", "b1", 3.25)], schema), str(tmp_path / "out" / "predictions")
    files.write_predictions(old, path)
    broken = spark.range(50).selectExpr(
        "string(id) AS user_id", "'b' AS business_id", "IF(id = 49, raise_error('stop'), 1.0) AS prediction"
    )
    with pytest.raises(Exception, match="stop"):
        files.write_predictions(broken, path)
    assert rows_of(files.read_predictions(spark, path)) == rows_of(old)
    new = spark.createDataFrame([("u2", "b2", 1.0)], schema)
    files.write_predictions(new, path)
    # A result may be made from the one that it replaces.
    files.write_predictions(files.read_predictions(spark, path).withColumn("prediction", F.lit(2.0)), path)
    assert rows_of(files.read_predictions(spark, path)) == [("u2", "b2", 2.0)]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["predictions"]


def test_a_failed_swap_puts_the_old_predictions_back(spark, tmp_path):
    path = str(tmp_path / "predictions")
    old = spark.createDataFrame([("u1", "b1", 3.25)], "user_id string, business_id string, prediction double")
    files.write_predictions(old, path)
    with pytest.raises(OSError, match="cannot take the place"):
        folders.replace(spark, str(tmp_path / "not there"), path, str(tmp_path / "before"))
    assert rows_of(files.read_predictions(spark, path)) == rows_of(old)

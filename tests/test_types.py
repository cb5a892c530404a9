"""Types of text columns, found by one look at every value."""
import pytest
from pyspark.sql import functions as F

from modelscout.sources import tables

VALUES = ["1", "+5", "-7\n", "3000000000", "99999999999999999999", "1.5", "1e3", "NaN", "-Infinity", ".", "2020-01-31", "2020-13-31", "2020-01-31 10:00",
          "2020-01-31T10:00:00.5", "2020-01-31 10:00:00Z", "2020-01-31 10:00:00+02:00", "TRUE", "false", " 1", "x", ""]


def test_a_value_is_taken_for_the_kinds_that_its_first_kind_tells(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    fits = [F.coalesce(F.col("v").rlike(f"^(?:{p})$") & F.col("v").try_cast(k).isNotNull(), F.lit(False)).alias(k) for k, p in tables.KINDS]
    for row in df.select("v", *fits).collect():
        taken = [k for k, _ in tables.KINDS if row[k]]
        assert taken[1:] == list(tables.ALSO.get(taken[0], ())) if taken else True, row


@pytest.mark.parametrize("values,want", [
    (["1", None, "2"], "int"), (["1", "3000000000"], "bigint"), (["3000000000"], "bigint"), (["1", "2.5", "3000000000"], "double"),
    (["99999999999999999999", "1"], "double"), (["2020-01-31", None], "date"), (["2020-01-31", "2020-01-31 10:00"], "string"),
    (["2020-01-31 10:00"], "timestamp_ntz"), (["2020-01-31 10:00:00Z"], "timestamp"), (["true", "FALSE"], "boolean"), (["1", "true"], "string"),
    (["1", ""], "string"), ([None, None], "string"), ([], "string"),
])
def test_types(spark, values, want):
    df = spark.createDataFrame([(v, "x") for v in values], "`a.b` string, c string")
    assert tables._tighten(df).dtypes == [("a.b", want), ("c", "string")]

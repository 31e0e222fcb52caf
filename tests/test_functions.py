import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, stats, text, vectors


def one(spark, expr, **cols):
    names = list(cols) or ["_x"]
    return spark.createDataFrame([tuple(cols.values()) or (1,)], names).select(expr.alias("r")).first()["r"]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert tuple(df.agg(*stats.quantiles("v", 0.25, 0.5)).first()) == (1.75, 2.5)


def test_weighted_quantiles(spark):
    rows = [("a", 10.0, 1.0), ("a", 20.0, 3.0), ("a", 30.0, 1.0), ("a", 99.0, 0.0), ("a", None, 5.0), ("b", 1.0, -1.0)]
    out = stats.weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", p25=0.25, p50=0.5).collect()
    assert [(r.k, r.p25, r.p50) for r in out] == [("a", 20.0, 20.0)]


def test_day_differences_of_negative_spans(spark):
    a, b = datetime(2024, 1, 2, 1), datetime(2024, 1, 1)
    assert one(spark, stats.floor_days("a", "b"), a=a, b=b) == -2
    assert one(spark, stats.whole_days("a", "b"), a=a, b=b) == -1
    assert one(spark, stats.whole_days("b", "a"), a=a, b=b) == 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [("הראל חברה לביטוח בע\"מ", "הראל"), ("הראל", "הראל"), ("סוכנות כהן, הראל חברה לביטוח", "הראל"), ("המוסד לביטוח לאומי", "ביטוח לאומי"), ("ביטוח ישיר", "ביטוח ישיר"), ("ביטוח", "ביטוח"), ("  הראל   ביטוח ", "הראל"), ("נימרוד חברה לביטוח", "נימרוד")],
)
def test_insurer_names(spark, raw, want):
    assert one(spark, text.term("insurer", "x"), x=raw) == text.fold(want)


def test_normalize_and_synonyms(spark):
    assert one(spark, text.normalize("x"), x="  כאבי  ג\"ב ") == "כאבי גב"
    assert one(spark, text.term("injury", "x"), x="פריצת דיסק") == "דיסק"
    assert one(spark, text.term("bodyPart", "x"), x="כתף ימין") == text.fold("כתף")
    assert one(spark, text.term("injury", "x"), x="Whiplash") == "whiplash"


def test_contact_points(spark):
    assert one(spark, text.contact_point("e", "p"), e=" A@B.c ", p="05-1") == "e:a@b.c"
    assert one(spark, text.contact_point("e", "p"), e=" ", p="05-1") == "p:051"
    assert one(spark, text.contact_point("e", "p"), e="", p="-") == ""


def test_lenient_dates(spark):
    assert one(spark, dates.lenient_date("x"), x=" 3.4.21 ") == "2021-04-03"
    assert one(spark, dates.lenient_date("x"), x="31/02/2020") == "2020-02-31"
    assert one(spark, dates.lenient_date("x"), x="32/02/2020") is None
    assert one(spark, dates.dates_in("x"), x="from 1.2.2020 to 03-04-21 and 1.2.2020") == ["2020-02-01", "2021-04-03"]


def test_observation_times(spark):
    assert one(spark, dates.observation_time("x"), x="2024-03-05T22:10:00Z") == datetime(2024, 3, 5)
    assert one(spark, dates.observation_time("x"), x="5/3/2024") == datetime(2024, 3, 5)
    assert one(spark, dates.observation_time("x"), x="31/2/2024") is None
    assert one(spark, dates.observation_time("x"), x="soon") is None


def test_cosine(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None


def test_content_hash_ignores_white_space(spark):
    assert one(spark, text.content_hash("x"), x=" a \n b ") == one(spark, text.content_hash("x"), x="a b")


@pytest.mark.parametrize(("most", "splits"), [(20, 8), (10**6, 1024)])
def test_exact_quantiles_equal_percentile(spark, most, splits):
    rng = random.Random(most)
    rows = [(rng.choice(["a", "b", None]), None if i % 50 == 0 else rng.choice([1e-9, 1.0, 1.0, rng.random() * 10 ** rng.randrange(9), -rng.random(), float(rng.randrange(5))]), rng.choice([0, 1, 2, 5])) for i in range(600)] + [("one", 7.0, 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    ps = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = stats.exact_quantiles(df, ["g"], "v", most=most, splits=splits, **ps)
    want = df.where("v is not null").groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(x) for x, p in ps.items()))
    near = lambda t: {r.g: [pytest.approx(r[x], rel=1e-12) for x in ps] for r in t.collect()}
    assert {r.g: [r[x] for x in ps] for r in got.collect()} == near(want)
    weighted = stats.exact_quantiles(df, ["g"], "v", "w", most=most, splits=splits, p25=0.25, p50=0.5, p75=0.75).collect()
    plain = stats.weighted_quantiles(df, ["g"], "v", "w", p25=0.25, p50=0.5, p75=0.75).collect()
    assert sorted(map(tuple, weighted), key=repr) == sorted(map(tuple, plain), key=repr)
    whole = stats.exact_quantiles(df, [], "v", most=most, splits=splits, p50=0.5).first().p50
    assert whole == pytest.approx(df.agg(F.percentile("v", F.lit(0.5))).first()[0])
    assert stats.exact_quantiles(df.limit(0), [], "v", p50=0.5).count() == 0
